"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Training sees at most ``MAX_ROWS`` labelled rows, chosen by a hash of their id. What it brings to the driver is bounded
by that: lexicon counts and a dozen numbers a row, never texts. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.batch import worker_cache

#: The bound on the labelled rows that a model is fitted on.
MAX_ROWS = 20_000
#: A stem is counted from so many toxic training texts on; each text has fewer stems than four times its words.
LEAST = 3
#: Rows a leaf of a tree must have.
LEAF = 8
FOLDS = 4
THRESHOLD = 0.7
#: A word is looked up whole and by its stems of these lengths.
STEMS = (4, 5, 6)
#: How far, in words, a second person stands from a lexicon word that it counts for.
NEAR = 5

SECOND_PERSON = frozenset(
    "you your yours yourself u ur thou thee du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros".split()
)
FEATURES = (
    "lexicon density; lexicon hits; strongest entry; mean entry; second-person proximity; second-person density; "
    "capitals; words in capitals; punctuation; exclamations; obfuscation; obfuscated lexicon density; words"
).split("; ")

_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[^\W\d_]+(?:[0-9@$*!|.\-]+[^\W\d_]+)+")
#: What every match of _MIXED holds.
_HINT = re.compile(r"[0-9@$*!|.\-][^\W\d_]")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": "", ".": "", "-": ""})


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def stems(word: str) -> tuple[str, ...]:
    """The keys of a word: ``=word`` and its longer stems ``word~``."""
    return ("=" + word, *(word[:k] + "~" for k in STEMS if len(word) >= k))


class _Memo(dict):
    """The strongest entry of each word met so far; starts anew when it has grown large."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        got = max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0)
        self[word] = got
        return got


def features(text: str | None, lexicon: _Memo) -> list[float]:
    """The FEATURES of one text, read whole; null and empty texts give zeros.

    Letters, capitals and marks are those of Unicode: a character is looked up in a table of all code points.
    """
    import numpy as np
    from math import log1p

    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * 8 + [float(bool(text.strip()))] + [0.0] * 4
    lows = list(map(str.lower, words))
    scores = list(map(lexicon.__getitem__, lows))
    hits = [i for i, s in enumerate(scores) if s] if any(scores) else []
    you = [i for i, w in enumerate(lows) if w in SECOND_PERSON]
    close = 0
    if hits and you:
        from bisect import bisect_left

        for h in hits:
            k = bisect_left(you, h - NEAR)
            close += k < len(you) and you[k] <= h + NEAR
    if text.isascii():
        kinds = _kinds()[np.frombuffer(text.encode(), np.uint8)]
    else:
        kinds = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    _, lower, upper, marks = np.bincount(kinds, minlength=4).tolist()
    shout = sum(1 for w in filter(str.isupper, words) if len(w) > 1)
    mixed = _MIXED.findall(text) if _HINT.search(text) else ()
    hidden = sum(1 for m in mixed if lexicon[m.lower().translate(_PLAIN)])
    return [
        len(hits) / n, log1p(len(hits)), max(scores), sum(scores) / n, close / n, len(you) / n,
        upper / max(lower + upper, 1), shout / n, marks / len(text), (text.count("!") + text.count("?")) / n,
        len(mixed) / n, hidden / n, log1p(n),
    ]


@lru_cache(maxsize=1)
def _kinds():
    """For every code point: 1 a letter that is no capital, 2 a capital, 3 a mark or symbol, 0 all else."""
    import unicodedata

    import numpy as np

    code = {"Lu": 2, "Lt": 2} | dict.fromkeys(("Ll", "Lm", "Lo"), 1)
    code |= dict.fromkeys(("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So"), 3)
    return np.array([code.get(unicodedata.category(chr(c)), 0) for c in range(0x110000)], np.uint8)


class Trees:
    """Gradient-boosted regression trees on the logistic loss, over quantile bins of each feature."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, leaf: int = LEAF, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.ridge = rounds, depth, rate, bins, leaf, ridge

    def fit(self, x, y) -> Trees:
        import numpy as np

        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(m)])
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        raw, self.trees = np.full(n, self.base), []
        size = 1 << self.depth
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-raw))
            g, h = y - prob, prob * (1 - prob)
            node = np.zeros(n, dtype=np.int64)
            splits = []
            for level in range(self.depth):
                k = 1 << level
                best = [(1e-6, 0, self.bins + 1)] * k  # gain, feature, bin: rows up to the bin go left
                for j in range(m):
                    at = node * (self.bins + 1) + b[j]
                    cut = k * (self.bins + 1)
                    sums = [np.bincount(at, w, cut).reshape(k, -1).cumsum(1) for w in (g, h, None)]
                    gl, hl, cl = sums
                    gt, ht, ct = (s[:, -1:] for s in sums)
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(cl < self.leaf) | (ct - cl < self.leaf)] = 0
                    for i, c in enumerate(gain.argmax(1)):
                        if gain[i, c] > best[i][0]:
                            best[i] = (gain[i, c], j, int(c))
                splits.append([(j, c) for _, j, c in best])
                f, c = np.array([s[1] for s in best]), np.array([s[2] for s in best])
                node = node * 2 + (b[f[node], np.arange(n)] > c[node])
            value = self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + self.ridge)
            raw = raw + value[node]
            self.trees.append((splits, value))
        return self

    def raw(self, x):
        import numpy as np

        n, m = x.shape
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(m)]) if n else np.zeros((m, 0), int)
        out, rows = np.full(n, self.base), np.arange(n)
        for splits, value in self.trees:
            node = np.zeros(n, dtype=np.int64)
            for level in splits:
                f, c = np.array([s[0] for s in level]), np.array([s[1] for s in level])
                node = node * 2 + (b[f[node], rows] > c[node])
            out += value[node]
        return out


def isotonic(x, y):
    """(points, values) of the non-decreasing step function nearest to (x, y), by pooling adjacent violators."""
    import numpy as np

    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first x
    for xi, yi in zip(x[order], y[order]):
        blocks.append([float(yi), 1.0, float(xi)])
        while len(blocks) > 1 and (blocks[-2][2] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            s, c, _ = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    """``lexicon``: entry -> weight. Without ``trees`` (too few labels to learn from) every score is 0."""

    lexicon: dict[str, float] = field(default_factory=dict)
    trees: Trees | None = None
    points: object = None
    values: object = None

    def score(self, x):
        """Calibrated scores; a hundredth of the uncalibrated probability keeps the order within flat steps."""
        import numpy as np

        if self.trees is None:
            return np.zeros(len(x))
        raw = self.trees.raw(x)
        step = self.values[np.clip(np.searchsorted(self.points, raw, side="right") - 1, 0, None)]
        return 0.99 * step + 0.01 / (1 + np.exp(-raw))


def _counted(rows: DataFrame, wanted: list[str] | None) -> DataFrame:
    """(stem, fold, toxic, n): in how many texts a stem occurs; only the ``wanted`` ones if given."""
    held = None if wanted is None else rows.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def run(batches):
        from collections import Counter

        keep = None if held is None else held.value
        for b in batches:
            n: Counter = Counter()
            for text, fold, toxic in zip(*(c.to_pylist() for c in b.columns)):
                found = {s for w in set(_WORD.findall((text or "").lower())) for s in stems(w)}
                n.update((s, fold, toxic) for s in (found if keep is None else found & keep))
            k = list(n)
            cols = [[x[0] for x in k], [x[1] for x in k], [x[2] for x in k], [n[x] for x in k]]
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["stem", "fold", "toxic", "n"])

    got = rows.select("text", "fold", "toxic").mapInArrow(run, "stem string, fold int, toxic int, n long")
    return got.groupBy("stem", "fold", "toxic").agg(F.sum("n").alias("n"))


def _least(totals: dict, without: int | None) -> float:
    """In how many toxic texts of the folds in use a stem must stand: four in a thousand, and LEAST."""
    return max(LEAST, 0.004 * sum(n for (f, y), n in totals.items() if y == 1 and f != without))


def _lexicon(counts: dict, totals: dict, without: int | None) -> dict[str, float]:
    """Stems found at least 12 times as often in toxic texts, by the logarithm of that ratio; a fold may be left out."""
    from math import log

    use, least = [f for f in range(FOLDS) if f != without], _least(totals, without)
    t1, t0 = (max(1, sum(totals.get((f, y), 0) for f in use)) for y in (1, 0))
    out = []
    for s, c in counts.items():
        a, b = (sum(c.get((f, y), 0) for f in use) for y in (1, 0))
        if a >= least:
            ratio = (a / t1) / ((b + 0.5) / t0)
            if ratio >= 12:
                out.append((log(ratio), a, s))
    return {s: w for w, _, s in sorted(out, key=lambda e: (-e[1], e[2]))}


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic, fold, part) of at most ``max_rows`` labelled rows outside the held-out third, one row per text."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where(F.col("text").isNotNull())
    rows = rows.groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    h = F.xxhash64("digest")
    return rows.select(
        "text", "toxic", F.pmod(h, F.lit(FOLDS)).cast("int").alias("fold"), F.pmod(F.shiftrightunsigned(h, 8), F.lit(10)).cast("int").alias("part")
    )


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learns lexicon, trees and calibration from labelled documents; labels are read nowhere else.

    The lexicon holds word stems that are far more frequent in toxic texts. A training row's features come from the
    lexicon of the other folds, so that the trees do not see a row's own words as entries. Seven tenths of the rows grow
    the trees, the others calibrate them. With fewer than four rows of either label the model scores 0. Null texts and
    ids, and labels without a document, teach nothing; equal texts are one row, toxic if one of them is; of an id's
    several labels the highest counts; long texts are read whole. ``docs`` and ``labels`` may have any further columns.
    """
    import numpy as np

    from lodeframe.storage import cut, release

    rows = cut(sample(docs, labels, max_rows), "labelled")
    totals = {(r[0], r[1]): r[2] for r in rows.groupBy("fold", "toxic").count().collect()}
    if min(sum(n for (_, y), n in totals.items() if y == v) for v in (0, 1)) < 4:
        release(rows)
        return Model()
    least = min(_least(totals, f) for f in range(FOLDS))
    stem = _counted(rows.where("toxic = 1"), None).groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    wanted = [r[0] for r in stem.collect()]  # at most 250 times the stems of a mean toxic text
    counts: dict[str, dict] = {}
    for s, f, y, n in _counted(rows, wanted).collect():  # at most FOLDS * 2 rows a stem
        counts.setdefault(s, {})[f, y] = n
    lexicons = rows.sparkSession.sparkContext.broadcast([_lexicon(counts, totals, f) for f in range(FOLDS)])

    def run(batches):
        memos = [_Memo(x) for x in lexicons.value]
        for b in batches:
            text, toxic, fold, part = b.columns
            x = [features(t.as_py(), memos[f]) for t, f in zip(text, fold.to_pylist())]
            yield pa.RecordBatch.from_arrays([toxic, part, pa.array(x, pa.list_(pa.float64()))], names=["toxic", "part", "x"])

    got = rows.mapInArrow(run, "toxic int, part int, x array<double>").collect()  # at most max_rows short rows
    release(rows)
    got.sort(key=lambda r: (r["part"], r["toxic"], r["x"]))
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], dtype=float)
    grow = np.array([r["part"] < 7 for r in got])
    if len(set(y[grow])) < 2 or len(set(y[~grow])) < 2:
        grow[:] = True
    trees = Trees().fit(x[grow], y[grow])
    rest = ~grow if not grow.all() else grow
    points, values = isotonic(trees.raw(x[rest]), y[rest])
    return Model(_lexicon(counts, totals, None), trees, points, values)


def score(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on).

    No shuffle; texts pass in bounded Arrow batches and only they decide. Null and empty texts get the score of a text
    without words. Repeated rows stay repeated; an empty table gives an empty result.
    """
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("score", T.DoubleType(), False)])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np

        worker_cache(None)
        m = held.value
        memo = _Memo(m.lexicon)
        for b in batches:
            x = np.array([features(t.as_py(), memo) for t in b.column(len(keep))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.score(x), pa.float64())], names=[*keep, "score"])

    got = docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
    return got.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def kept(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic.

    Null and empty texts are scored as texts without words, long ones are read whole, repeated rows stay or go together,
    an empty table stays empty, and columns may have any names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        import numpy as np

        worker_cache(None)
        m = held.value
        memo = _Memo(m.lexicon)
        x = np.array([features(t.as_py(), memo) for t in texts]).reshape(-1, len(FEATURES))
        return pa.array(m.score(x), pa.float64())

    return docs.where(scored(F.col(text)) < THRESHOLD)
