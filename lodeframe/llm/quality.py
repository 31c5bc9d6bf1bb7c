"""Quality rules as a bitmask ledger.

``ledger`` reads every text once: it measures it and evaluates every rule, keeping the measurements and one bit per
failed rule. Policies are sets of rules with a version; applying one is a bitwise AND, so a new policy, or the question
what a rule alone removes (``ablation``), never reads a text again.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.batch import worker_cache

#: The measurements of a text, all long.
MEASURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_lower n_bangs n_stutter".split()

SYMBOLS = "#*$%&|<>"
_UPPER, _LOWER = (bytes(range(a, a + 26)) for a in b"Aa")
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements, in integers only, so that every engine agrees on it."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_passages", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "duplicate_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "capitals", "n_upper > n_lower"),
    Rule(7, "exclamations", "100 * n_bangs > 20 * n_words"),
    Rule(8, "stutter", "100 * n_stutter > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules: a document is kept if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def label(self) -> str:
        return f"{self.name}/{self.version}"

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[n] for n in dict.fromkeys(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_passages"))
STRICT = Policy("strict", 1, tuple(r.name for r in RULES))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a run of ``window`` words that is found twice or more, its first place included.

    Runs are compared exactly: ranks of words are combined into ranks of runs, so memory stays at a few integers a word.
    """
    import numpy as np

    n = len(words)
    if n <= window:
        return 0
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    rank = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    run, size = rank, 1
    while size < window:
        step = min(size, window - size)
        pair = run[: n - size - step + 1] * np.int64(n) + run[step : n - size + 1]
        run, size = np.unique(pair, return_inverse=True)[1], size + step
    twice = np.bincount(run)[run] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The ``MEASURES`` of one text; null and empty texts give zeros.

    Words are runs of characters other than x20 and x09-x0D; lines are split at newlines and count if they have a word.
    """
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    less = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words), len(text) - less(b" \t\n\x0b\x0c\r"), less(SYMBOLS.encode()), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), less(_UPPER), less(_LOWER), raw.count(b"!"), sum(map(eq, words, words[1:])),
    )


def failure_bits(rules: tuple[Rule, ...] = RULES, inside: str = "") -> Column:
    """The bits of the rules that fail, from columns named as the measurements or fields of the struct ``inside``."""
    out = F.lit(0).cast("long")
    for r in rules:
        fails = re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"`{inside}`.\1", r.fails) if inside else r.fails
        out = out.bitwiseOR(F.when(F.expr(fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out


def kept(docs: DataFrame, policy: Policy, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that fail none of the policy's rules; rejected rows go.

    The rows' ledger entries are made on the way and the policy is applied to their bits. Null, empty and white-space
    texts measure zero, a long text is measured whole, repeated rows stay or go together, an empty table stays empty, and
    columns may have any names.
    """
    entry = "entry"
    while entry in docs.columns:
        entry += "_"

    @F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
    def measured(texts: pa.Array) -> pa.Array:
        worker_cache(None)
        rows = [measure(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))], MEASURES)

    bits = failure_bits(rules, entry)
    return docs.withColumn(entry, measured(F.col(text))).where(bits.bitwiseAND(F.lit(policy.mask(rules))) == 0).drop(entry)


def ledger(docs: DataFrame, *keep: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns ``keep`` of each row, its measurements and ``fail_bits``: bit ``r.bit`` is set if it fails rule ``r``.

    No shuffle; texts pass through Python in bounded Arrow batches. Null and empty texts measure zero. Repeated rows
    stay repeated, other columns are dropped, an empty table gives an empty ledger.
    """
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(m, T.LongType(), False) for m in MEASURES])

    def run(batches):
        worker_cache(None)
        for b in batches:
            rows = [measure(x.as_py()) for x in b.column(len(keep))]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*keep, *MEASURES])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema).withColumn("fail_bits", failure_bits(rules))


def apply_policy(entries: DataFrame, policy: Policy, column: str = "kept", label: str | None = None) -> DataFrame:
    """Adds ``column``: whether the row fails none of the policy's rules; and ``label``, if given: the policy's name and version."""
    if label:
        entries = entries.withColumn(label, F.lit(policy.label))
    return entries.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(policy.mask())) == 0)


def ablation(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule of the policy: rows it fails, rows only it fails, and rows kept if it were left out.

    The ledger is first summed by its masked failure bits (at most 2**rules rows, combined before the shuffle); all the
    rest is bit tests on those sums.
    """
    mask = policy.mask(rules)
    sums = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    listed = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("one")) for r in rules if mask >> r.bit & 1)))
    return (
        sums.select("bits", "n", listed.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.one")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.one"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("r.one")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
