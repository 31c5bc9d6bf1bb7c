"""Source divergence audit: how far the word use of each source lies from that of the others of its language.

A count-min sketch of document frequencies is built in every task, merged, and sent back; it never underestimates, so a
term that it puts below the limit cannot be kept and is dropped before anything is shuffled. The survivors are counted
exactly, and sources are compared by joins of the terms that both use; the rest of each sum follows from histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.batch import slices
from lodeframe.storage import cut, holding, release

#: A term is kept in a language from so many of its documents on.
LEAST_DOCS = 30
SMOOTH, SCALE, TOP = 5, 1_000_000_000, 50
#: Rows of the sketch; its width is about CELLS_PER_DOC cells a document, a power of two within WIDTHS. The upper bound
#: bounds memory (a byte a cell, 48 MB in all); beyond it the sketch drops fewer terms, and results stay the same.
DEPTH, CELLS_PER_DOC, WIDTHS = 3, 4, (16, 24)
#: Cells of the sketch that travel together.
BLOCK = 1 << 16
#: Counted rows that a task holds before it adds equal ones up.
HELD = 1_000_000

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def terms(texts):
    """(words, number of the text of each) of an Arrow array of strings without nulls.

    A term is a run of letters A-Z, a-z and of characters beyond ASCII; only A-Z are lower-cased. All of this happens on
    the bytes of the whole batch: a character beyond ASCII consists of bytes from 0x80 on.
    """
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.string())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    code = np.arange(256)
    upper = (code >= 0x41) & (code <= 0x5A)
    inside = (upper | ((code >= 0x61) & (code <= 0x7A)) | (code >= 0x80))[data]
    low = np.where(upper, code + 32, code).astype(np.uint8)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < ends[1:]]  # a text's first byte goes on no word of the text before
    first[begins] = inside[begins]
    at = np.flatnonzero(first)
    kept = np.cumsum(inside)
    offsets = np.append(kept[at] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(low[data[inside]]))
    return words, np.searchsorted(ends, at, side="right") - 1


def cells_of(words: list, langs: list, which, width_bits: int):
    """For each word of the language with number ``which`` its cell in each row of the sketch."""
    import numpy as np
    import pandas as pd

    h = pd.util.hash_array(np.array(words, object), categorize=False)
    own = pd.util.hash_array(np.array(langs, object), categorize=False)
    with np.errstate(over="ignore"):
        h = h ^ (own[which] * np.uint64(_ODD[-1]))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD[0])
        mixed = [(h ^ (h >> np.uint64(29 + 2 * i))) * np.uint64(_ODD[i]) for i in range(DEPTH)]
    return [(x >> np.uint64(64 - width_bits)).astype(np.int64) + (i << width_bits) for i, x in enumerate(mixed)]


def _counted(langs: list, texts):
    """(dictionary of terms, numbers of text, number of term, occurrences) of each different pair of text and term."""
    import numpy as np

    words, doc = terms(texts)
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    pair, n = np.unique(doc * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return coded.dictionary, pair // size, pair % size, n


def _numbered(values: list):
    import numpy as np

    names = sorted(set(values))
    place = {v: i for i, v in enumerate(names)}
    return names, np.array([place[v] for v in values], np.int64)


def sketch(rows: DataFrame, width_bits: int, least: int = LEAST_DOCS):
    """The merged sketch of document frequencies of (lang, term), counted up to ``least``, as one numpy array.

    Each task adds up its own table and sends its blocks that are not empty; the blocks' tables are added as they arrive,
    so a task holds its share of one sketch whatever the number of tasks before. What reaches the driver is one sketch.
    """
    import numpy as np
    import pyarrow as pa

    kind = np.uint8 if least <= 127 else np.uint32
    cells = DEPTH << width_bits

    def fill(batches):
        table = np.zeros(cells, kind)
        for b in batches:
            for i, j in slices(b.column(1)):
                names, lang = _numbered(b.column(0).slice(i, j - i).to_pylist())
                found, doc, term, _ = _counted(names, b.column(1).slice(i, j - i))
                if not len(term):
                    continue
                key, docs = np.unique(lang[doc] * len(found) + term, return_counts=True)
                which, term = key // len(found), key % len(found)
                words = found.to_numpy(zero_copy_only=False)[term]
                for c in cells_of(words, names, which, width_bits):
                    at, back = np.unique(c, return_inverse=True)
                    n = table[at] + np.bincount(back, docs).astype(np.int64)
                    table[at] = np.minimum(n, least).astype(kind)
        for k in range(0, cells, BLOCK):
            if (part := table[k : k + BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "cells"])

    def merge(batches):
        held: dict = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
                got = np.frombuffer(raw.as_buffer(), kind)
                held[k] = np.minimum(held[k].astype(np.int64) + got, least).astype(kind) if k in held else got.copy()
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "cells"])

    parts = rows.select("lang", "text").mapInArrow(fill, "block int, cells binary")
    blocks = -(-cells // BLOCK)
    out = np.zeros(cells, kind)
    for r in parts.repartition(min(64, blocks), "block").mapInArrow(merge, "block int, cells binary").collect():
        out[r[0] * BLOCK : (r[0] + 1) * BLOCK] = np.frombuffer(bytes(r[1]), kind)
    return out


def counts(rows: DataFrame, table, width_bits: int, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, docs): exact counts of the terms that the sketch ``table`` does not rule out.

    A task adds equal rows up before it sends them, so a term of every document is a few rows.
    """
    import numpy as np
    import pyarrow as pa

    schema = "lang string, source string, term string, n long, docs long"
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def added(tables: list):
        t = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

    def run(batches):
        held, size, table = [], 0, sent.value
        for b in batches:
            for i, j in slices(b.column(2)):
                langs, lang = _numbered(b.column(0).slice(i, j - i).to_pylist())
                sources, source = _numbered(b.column(1).slice(i, j - i).to_pylist())
                found, doc, term, n = _counted(langs, b.column(2).slice(i, j - i))
                if not len(term):
                    continue
                pair, back = np.unique(lang[doc] * len(found) + term, return_inverse=True)
                words = found.to_numpy(zero_copy_only=False)[pair % len(found)]
                low = np.min([table[c] for c in cells_of(words, langs, pair // len(found), width_bits)], axis=0)
                on = (low >= least)[back]
                key, back = np.unique((pair[back[on]] * len(sources)) + source[doc[on]], return_inverse=True)
                some, of = key // len(sources), key % len(sources)
                total, docs = np.bincount(back, n[on], len(key)), np.bincount(back, minlength=len(key))
                cols = [
                    pa.array(langs, pa.string()).take(pa.array(some // len(found))), pa.array(sources, pa.string()).take(pa.array(of)),
                    found.take(pa.array(some % len(found))), pa.array(total.astype(np.int64)), pa.array(docs.astype(np.int64)),
                ]
                held.append(pa.Table.from_arrays(cols, names=["lang", "source", "term", "n", "docs"]))
                size += len(key)
                if size > HELD:
                    held = [added(held)]
                    size = len(held[0])
                    if size > HELD // 2:
                        yield from held[0].to_batches(20_000)
                        held, size = [], 0
        if held:
            yield from added(held).to_batches(20_000)

    part = rows.select("lang", "source", "text").mapInArrow(run, schema)
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column | str, total: Column | str, v: Column | str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * v)) in whole numbers; null where there is no term."""
    wide = lambda c, n: c.cast(f"decimal({n},0)")
    col = lambda c: F.col(c) if isinstance(c, str) else c
    below = F.nullif(col(total) + SMOOTH * col(v), F.lit(0))
    got = F.call_function("div", wide(col(count) + SMOOTH, 20) * wide(F.lit(SCALE), 10), wide(below, 20))
    return got + 1


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others, and by which terms.

    Part ``pair`` has the other sources of the language with the sum of the differences of all kept terms' shares, part
    ``term`` the ``top`` terms that the source uses more than its language. Shares are whole numbers (parts of SCALE,
    smoothed), so every value is exact. Null texts, languages and sources count as empty ones; a group without terms has
    pairs, too; a language with one source has none; repeated rows count each time; ties go by the item's bytes; an
    empty table gives no rows; other columns are ignored. Texts are read whole, a slice of a batch at a time.
    """
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    width = min(max((CELLS_PER_DOC * docs.count()).bit_length(), WIDTHS[0]), WIDTHS[1])
    counted = cut(counts(own, sketch(own, width, least), width, least), "survivors")
    whole = counted.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = cut(counted.drop("docs").join(whole.drop("docs"), ["lang", "term"]), "kept")
    release(counted)

    once = kept.groupBy("lang", "term").agg(F.max("of_lang").alias("n"))
    langs = once.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_total")))
    groups = cut(groups.withColumn("z", F.coalesce(_share(zero, "total", "v"), zero)), "groups")
    used = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "v"))

    more = used.withColumn("q", _share("of_lang", "lang_total", "v")).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_term = by_term.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    by_pair = distances(used, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    by_pair = by_pair.withColumn("rank", F.row_number().over(best))
    return holding(by_pair.unionByName(by_term), kept, groups)


def distances(used: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language: the sum over all kept terms of |p - q|.

    ``used`` has a share ``p`` for the terms that a source has, ``groups`` its share ``z`` of any other. With
    |z - z'| for every term as a start, a term of one source alone adds |p - z'| - |z - z'|, which depends on the term's
    count only, so each source's histogram of counts is enough; a term of both corrects that in a join of the sources
    that hold it. No term of neither is looked at.
    """
    far = lambda a, b: F.abs(F.col(a) - F.col(b))
    one, two = groups.alias("g"), groups.alias("h")
    pairs = one.join(two, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.source") != F.col("h.source")))
    pairs = pairs.select("g.lang", "g.source", F.col("h.source").alias("item"), F.col("g.z").alias("z"), F.col("h.z").alias("y"), F.col("g.v").alias("v"))
    seen = used.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).withColumnRenamed("lang", "l").withColumnRenamed("source", "s")
    alone = pairs.join(seen, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (far("p", "y") - far("z", "y"))).alias("part"))
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "part")

    a, b = used.select("lang", "term", "source", "p", "z").alias("a"), used.select("lang", "term", "source", "p", "z").alias("b")
    both = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    fix = far("a.p", "b.p") - far("a.p", "b.z") - far("a.z", "b.p") + far("a.z", "b.z")
    both = both.groupBy("a.lang", F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.sum(fix).alias("part"))
    swapped = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "part")

    start = pairs.select("lang", "source", "item", (F.col("v") * far("z", "y")).alias("part"))
    parts = start.union(alone).union(back).union(both).union(swapped)
    return parts.groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))
