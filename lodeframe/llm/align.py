"""Alignment of two tokenizers' tokens on the bytes of the same texts.

Neither tokenizer's tokens cross from what is no white space into a space, so texts fall into words that both cut at their
ends, and what both do within a word is the same wherever it occurs. Words are numbered once per part of the corpus, the
different ones are aligned by joins and windows, and every part gets the results of its own words back.
"""

from __future__ import annotations

import gc
import hashlib
import re
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodeframe.llm.batch import coded_words, joined, slices, word_of, worker_cache
from lodeframe.llm.tokenfile import _ODD, _SPACE, Encoder
from lodeframe.storage import cut, holding, release

#: Bytes of text whose words are numbered together; a longer text is a part of its own.
PART_BYTES = 32 << 20
#: Bytes of text that are cut at a time, and texts that reach a worker at a time.
SLICE_BYTES, BATCH_ROWS = 4 << 20, 1000
#: Different pairs of ids (some 40 bytes each) up to which their counts are broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 500_000
#: Pairs are numbered a * WIDE + b.
WIDE = 1 << 31

_CUT = re.compile(f"(?<=[^\\s{_SPACE}])(?= )")


def pack(codes, sizes):
    """An Arrow array of binaries: the first ``sizes``[0] numbers, the next ``sizes``[1] and so on, 7 bits a byte."""
    import numpy as np
    import pyarrow as pa

    n = np.ones(len(codes), np.int64)
    for k in range(1, 5):
        n += codes >= 1 << 7 * k
    start = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(5):
        on = n > k
        if not on.any():
            break
        out[start[on] + k] = (codes[on] >> 7 * k & 127) | (n[on] > k + 1).astype(np.int64) << 7
    ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def unpack(raw):
    """The numbers that ``pack`` wrote in one binary."""
    import numpy as np

    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(b < 128)
    start = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(start, ends - start + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, start)


def numbered(docs: DataFrame, *keep: str, text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of two kinds. Documents: ``keep``, ``part``, ``row``, ``codes``, the numbers of their words in their part,
    packed. Words: ``part``, ``code``, ``word``, the space before it included. The frequent words have the low numbers.

    A null text and an empty one have no words; any other text is read with a space before it.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    kinds = [T.StructField(f"k{i}", docs.schema[k].dataType) for i, k in enumerate(keep)]
    more = [("part", T.LongType()), ("row", T.LongType()), ("codes", T.BinaryType()), ("code", T.LongType()), ("word", T.StringType())]
    schema = T.StructType(kinds + [T.StructField(n, t) for n, t in more])

    none = lambda n, t: pa.nulls(n, t)

    def written(part: int, known: dict[str, int], held: list):
        """The rows of one part: ``held`` lists (columns to keep, numbers of words, words in each text)."""
        m = len(known)
        often = np.zeros(m, np.int64)
        for _, which, _ in held:
            often += np.bincount(which, minlength=m)
        order = np.argsort(-often, kind="stable")
        place = np.zeros(m, np.int64)
        place[order] = np.arange(m)
        row = 0
        for cols, which, sizes in held:
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([
                *cols, pa.array(np.full(n, part)), pa.array(np.arange(row, row + n)), pack(place[which], sizes), none(n, pa.int64()), none(n, pa.string()),
            ], names=schema.names)
            row += n
        words, kinds = list(known), [c.type for c in held[0][0]]
        for k in range(0, m, 20_000):
            some = [word_of(words[w]) for w in order[k : k + 20_000].tolist()]
            n = len(some)
            yield pa.RecordBatch.from_arrays([
                *(none(n, t) for t in kinds), pa.array(np.full(n, part)), none(n, pa.int64()), none(n, pa.binary()),
                pa.array(np.arange(k, k + n)), pa.array(some, pa.string()),
            ], names=schema.names)

    def run(batches):
        worker_cache(None)
        part = TaskContext.get().partitionId() << 32
        known, held, size = {}, [], 0
        for b in batches:
            for i, j in slices(b.column(len(keep)), min(SLICE_BYTES, part_bytes)):
                texts = b.column(len(keep)).slice(i, j - i).fill_null("")
                odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.match_substring_regex(texts, "^[ \n]|^$"))
                keys, at, sizes = coded_words(texts, pc.invert(odd), lambda t: _CUT.split(" " + t) if t else [], True)
                used = np.flatnonzero(np.bincount(at, minlength=len(keys)))
                own = np.zeros(len(keys), np.int32)
                own[used] = [known.setdefault(keys[w], len(known)) for w in used.tolist()]
                held.append(([pa.concat_arrays([c.slice(i, j - i), c.slice(0, 0)]) for c in b.columns[: len(keep)]], own[at], sizes))
                size += pc.sum(pc.binary_length(texts)).as_py() or 0
                if size >= part_bytes:
                    yield from written(part, known, held)
                    part, known, held, size = part + 1, {}, [], 0
        if held:
            yield from written(part, known, held)

    return docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), F.col(text).alias("__text")).mapInArrow(run, schema)


class Library:
    """The tokens of words by one tokenizer, as (ids, byte lengths); none where their bytes are not the word's."""

    def __init__(self, path: str):
        import numpy as np

        if path.endswith(".model"):
            import sentencepiece

            m = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            known = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.vocab_size())]
            self.ids = self._pieces
        else:
            self.encoder = Encoder(path, remember=0, plain_specials=True)  # every word comes once
            names = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
            back = {c: b for b, c in self.encoder.shown.items()}
            known = [b""] * (max(names.values()) + 1)
            for name, i in names.items():
                known[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
            self.ids = self._byte_level
        self.sizes = np.array([len(b) for b in known])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(known), np.uint8)

    def _byte_level(self, words):
        import numpy as np

        got = self.encoder.encode(words)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.concatenate([np.zeros(0, np.uint32), *got]).astype(np.int64)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(sizes) - 1] = False  # the encoder ends each with an id of its own
        return flat[inner], sizes - 1

    def _pieces(self, words):
        """The library puts a space before a text: that is the word's own, or stands before a line break and is left out."""
        from itertools import chain

        import numpy as np

        words = words.to_pylist()
        own = [len(w) > 1 and w[0] == " " for w in words]
        got = self.model.encode([w[1:] if o else "\n" + w for w, o in zip(words, own)], num_threads=1)
        got = [x if o else x[2:] for x, o in zip(got, own)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int64, int(sizes.sum())), sizes

    def tokens(self, words):
        """An Arrow array of (ids, lens), two lists, for one of words."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(words):
            return pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("lens", pa.list_(pa.int16()))]))
        ids, sizes = self.ids(words)
        long = self.sizes[ids]
        made, ends = joined(self.flat, self.starts[ids], long)
        of = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        want = pc.binary_length(words).to_numpy().astype(np.int64)
        data = np.frombuffer(pc.binary_join(pa.array([words.to_pylist()]), "")[0].as_py().encode(), np.uint8)
        right = np.diff(of) == want
        if not right.all() or not np.array_equal(made, data):
            right = np.array([made[a:b].tobytes() == w.encode() for a, b, w in zip(of, of[1:], words.to_pylist())])
            on = np.repeat(right, sizes)
            ids, long, sizes = ids[on], long[on], np.where(right, sizes, 0)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(t))) for x, t in ((ids, np.int32), (long, np.int16))]
        return pa.StructArray.from_arrays(lists, names=["ids", "lens"])


def tokens_udf(path: str):
    """A column function: the ids of a word's tokens and their lengths in bytes."""
    import pyarrow as pa

    def tokens(words):
        held = worker_cache(("align",), dict)
        if path not in held:
            held[path] = Library(path)
        return held[path].tokens(words)

    tokens.__annotations__ = {"words": pa.Array, "return": pa.Array}
    return F.arrow_udf(tokens, "struct<ids:array<int>,lens:array<smallint>>")


@contextmanager
def _partitioned_by_some_keys(spark):
    """Rows that lie together by some of a join's keys are not shuffled again for all of them."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def aligned(words: DataFrame) -> DataFrame:
    """(w, groups) of words (w, a, b), a and b their tokens as ids and lens: the groups of
    ids between two ends that both tokenizers share.

    Tokens are exploded with their places, ends are running sums of their lengths, each side's ends are looked up in the
    other's by a join, and a token's group is how many shared ends come before it; the two sides' groups are joined. All
    rows of a word lie together from the first shuffle on. A word that one tokenizer does not give back has no groups.
    """
    keyed = words.repartition("w")

    def ends(side: str) -> DataFrame:
        spread = keyed.select("w", F.posexplode(F.arrays_zip(f"{side}.ids", f"{side}.lens")).alias("pos", "t"))
        upto = Window.partitionBy("w").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return spread.select("w", F.col("t.ids").alias("id"), F.sum("t.lens").over(upto).alias("end"))

    before = Window.partitionBy("w").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)

    def groups(side: str, other: str) -> DataFrame:
        met = ends(side).join(ends(other).select("w", "end", F.lit(1).alias("shared")), ["w", "end"], "left")
        placed = met.select("w", "end", "id", F.coalesce(F.sum("shared").over(before), F.lit(0)).alias("g"))
        ids = F.transform(F.array_sort(F.collect_list(F.struct("end", "id"))), lambda x: x["id"])
        return placed.groupBy("w", "g").agg(ids.alias(side))

    both = groups("a", "b").join(groups("b", "a"), ["w", "g"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("g", "a", "b"))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    return both.groupBy("w").agg(listed.alias("groups"))


def _cut(made, name: str, *how) -> DataFrame:
    """``cut`` of what ``made`` returns; the shuffles behind it, which nothing reads again, are let go of at once."""
    out = cut(made(), name, *how)
    for _ in range(2):  # the first round frees the plan, the second the shuffles that it held; deleting takes a moment
        gc.collect()
        out.sparkSession._jvm.System.gc()
        time.sleep(0.5)
    return out


def align(docs: DataFrame, *keep: str, a: str, b: str, text: str = "text", part_bytes: int = PART_BYTES, limit: int = BROADCAST_PAIRS) -> DataFrame:
    """The columns ``keep`` of each row, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    ``a`` and ``b`` are the files of a byte-level and of a sentencepiece tokenizer; texts are read with a space before
    them. Links are all pairs of an A and a B token of a group; a pair's count is the number of documents that hold it
    linked, ``count_sum`` adds it up over a document's links, and ``n_best`` counts the links whose count is the highest
    of their A id. Null and empty texts, and such that a tokenizer does not give back, have no tokens, zeros and an empty
    digest; repeated rows count each time; very long texts are parts of their own; an empty table stays empty; ``keep``
    may have any names but those of the results.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if clash := set(names) & set(keep):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    spark = docs.sparkSession
    parts = _cut(lambda: numbered(docs, *keep, text=text, part_bytes=part_bytes), "numbered", BATCH_ROWS)
    own = [f"k{i}" for i in range(len(keep))]
    rows = parts.where("codes IS NOT NULL").select("part", "row", "codes")
    words = parts.where("word IS NOT NULL").select(F.col("part").alias("of"), "code", "word")
    both = [tokens_udf(path)("word").alias(side) for path, side in ((a, "a"), (b, "b"))]
    each = _cut(lambda: words.select("word").distinct().select(F.monotonically_increasing_id().alias("w"), "word", *both), "words")
    with _partitioned_by_some_keys(spark):
        known = _cut(lambda: aligned(each).join(each.select("w", "word"), "w"), "aligned")
    release(each)

    marked = lambda ids, end: F.transform(ids, lambda x, i: x * 4 + F.when(i + 1 == F.size(ids), end).otherwise(0))
    facts = known.select("word", F.flatten(F.transform("groups", lambda g: F.concat(marked(g["a"], 1), marked(g["b"], 2)))).alias("marked"))
    first = _cut(lambda: _first(rows, words.join(facts, "word").drop("word")), "counted")

    count = first.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("docs"))
    best = Window.partitionBy(F.shiftright("pair", 31))
    pair = lambda x, y: x.cast("long") * WIDE + y
    count = cut(count.select("pair", "docs", (F.col("docs") == F.max("docs").over(best)).cast("long").alias("best")), "pairs")
    spread = known.select("word", F.explode("groups").alias("g")).select("word", F.explode("g.a").alias("x"), F.col("g.b").alias("ys"))
    spread = spread.select("word", "x", F.explode("ys").alias("y")).select("word", pair(F.col("x"), F.col("y")).alias("pair"))
    scored = spread.join(F.broadcast(count) if count.count() <= limit else count, "pair")
    scores = scored.groupBy("word").agg(F.sum("best").alias("n_best"), F.sum("docs").alias("count_sum"))
    second = _cut(lambda: _second(rows, words.join(scores, "word").drop("word")), "scored")

    found = first.where("row IS NOT NULL").drop("pair", "docs").join(second, ["part", "row"])
    ids = parts.where("codes IS NOT NULL").select("part", "row", *own)
    out = ids.join(found, ["part", "row"]).select(*(F.col(o).alias(k) for o, k in zip(own, keep)), *names)
    release(known, count)
    return holding(out, parts, first, second)


def _lookup(table, column: str, size: int, kind):
    """``column`` of the words' rows as an array by their numbers, zero for words without a row."""
    import numpy as np

    out = np.zeros(size, kind)
    out[table["code"].to_numpy()] = table[column].to_numpy()
    return out


def _facts(codes, lists, size: int, step: int = 40_000):
    """What a part knows of its words, by their numbers: counts, shown groups, and distinct pairs as places in ``met``.

    A word is a list of id * 4 + mark, the A ids of a group before its B ids; mark 1 ends the A ids, 2 the group. Words
    are taken ``step`` at a time, which bounds what stands beside the results.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    numbers, shown = np.zeros((size, 4), np.int64), np.full(size, None, object)
    counts, pairs = np.zeros(len(lists), np.int64), [np.zeros(0, np.int64)]
    for k in range(0, len(lists), step):
        some = lists.slice(k, step)
        own, n = codes[k : k + step], len(some)
        flat = some.flatten().to_numpy().astype(np.int64)
        sizes = pc.list_value_length(some).to_numpy().astype(np.int64)
        word, mark, ids = np.repeat(np.arange(n), sizes), flat & 3, flat >> 2
        group = np.cumsum(mark == 2) - (mark == 2)
        is_b = np.cumsum(mark == 1) - (mark == 1) > group
        of = word[mark == 2]
        na, nb = (np.bincount(group[on], minlength=len(of)) for on in (~is_b, is_b))
        for c, (w, x) in enumerate(((word[~is_b], None), (word[is_b], None), (of, None), (of, na * nb))):
            numbers[own, c] = np.bincount(w, x, n).astype(np.int64)
        parts = pc.binary_join_element_wise(pa.array(ids).cast(pa.string()), pa.array([",", "|", ";"]).take(pa.array(mark)), "")
        ends = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1)
        data, stop = parts.buffers()[2].to_pybytes(), np.cumsum(sizes)
        shown[own] = [data[i:j] for i, j in zip(ends[stop - sizes].tolist(), ends[stop].tolist())]
        one, two = (np.sort(group[on] * WIDE + ids[on]) for on in (~is_b, is_b))
        one, two = (x[np.diff(x, prepend=-1) > 0] for x in (one, two))  # an id once in a group
        go, gt = one // WIDE, two // WIDE
        each = np.bincount(gt, minlength=len(of))
        mate = joined(two % WIDE, (np.cumsum(each) - each)[go], each[go])[0]
        pairs.append(np.repeat(one % WIDE, each[go]) * WIDE + mate)
        counts[k : k + step] = np.bincount(of, np.bincount(go, minlength=len(of)) * each, n)
    met, link = np.unique(np.concatenate(pairs), return_inverse=True)
    starts, per = np.zeros(size, np.int64), np.zeros(size, np.int64)
    starts[codes], per[codes] = np.cumsum(counts) - counts, counts
    return numbers, shown, link.astype(np.int32), met, starts, per


def _first(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Each document's counts and digest, (part, row, ...), and each part's (pair, docs); one part is one group."""
    import numpy as np
    import pyarrow as pa

    schema = "part long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, docs long"
    kinds = [pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        worker_cache(None)
        docs = [unpack(x.as_buffer()) for x in left["codes"]]
        size = max([int(d.max()) for d in docs if len(d)], default=-1) + 1
        numbers, shown, link, met, starts, counts = _facts(right["code"].to_numpy(), right["marked"].combine_chunks(), size)
        sums, digests, seen = np.zeros((len(docs), 4), np.int64), [], np.zeros(len(met), np.int64)
        for i, d in enumerate(docs):
            listed = shown[d].tolist()
            if not listed or numbers[d, 0].min() == 0:  # no words, or one that a tokenizer does not give back
                digests.append("")
                continue
            sums[i] = numbers[d].sum(0)
            digests.append(hashlib.sha256(b"".join(listed)[:-1]).hexdigest())
            each = np.unique(d)
            hit = np.zeros(len(met), bool)
            hit[joined(link, starts[each], counts[each])[0]] = True
            seen += hit
        n, on = len(docs), np.flatnonzero(seen)
        m = len(on)
        part = left["part"].to_pylist()[:1] or right["of"].to_pylist()[:1]
        void = lambda k, t: pa.nulls(k, t)
        cols = [
            pa.array(part * (n + m), pa.int64()), pa.concat_arrays([left["row"].combine_chunks(), void(m, pa.int64())]),
            *(pa.concat_arrays([pa.array(sums[:, k]), void(m, pa.int64())]) for k in range(4)),
            pa.concat_arrays([pa.array(digests, pa.string()), void(m, pa.string())]),
            pa.concat_arrays([void(n, pa.int64()), pa.array(met[on])]), pa.concat_arrays([void(n, pa.int64()), pa.array(seen[on])]),
        ]
        return pa.Table.from_arrays([c.cast(t) for c, t in zip(cols, kinds)], names=names)

    return rows.groupBy("part").cogroup(words.groupBy("of")).applyInArrow(run, schema)


def _second(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(part, row, n_best, count_sum): the sums of the words' scores over each document."""
    import numpy as np
    import pyarrow as pa

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        worker_cache(None)
        docs = [unpack(x.as_buffer()) for x in left["codes"]]
        size = max([int(d.max()) for d in docs if len(d)], default=-1) + 1
        known = np.zeros(size, bool)
        known[right["code"].to_numpy()] = True
        scores = np.stack([_lookup(right, n, size, np.int64) for n in ("n_best", "count_sum")], axis=1)
        sums = np.zeros((len(docs), 2), np.int64)
        for i, d in enumerate(docs):
            if known[d].all():
                sums[i] = scores[d].sum(0)
        cols = [left["part"].combine_chunks(), left["row"].combine_chunks(), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
        return pa.Table.from_arrays(cols, names=["part", "row", "n_best", "count_sum"])

    return rows.groupBy("part").cogroup(words.groupBy("of")).applyInArrow(run, "part long, row long, n_best long, count_sum long")
