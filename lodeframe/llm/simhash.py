"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import gc
import time
from functools import reduce
from itertools import repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.batch import worker_cache
from lodeframe.llm.graph import connected_components
from lodeframe.storage import cut, holding, release

#: The seed of the first 64 bits; each further word of a wider fingerprint uses the next seed.
SEED = 42
#: A (bucket, component) pair with more members than this is compared with other components only.
DENSE = 64


def fingerprint_words(text: bytes | None, shingle: int = 3, words: int = 1, distinct: bool = False) -> list[int]:
    """The fingerprint of one text as ``words`` signed 64-bit integers.

    A-Z are lower-cased, tokens are runs of bytes other than ASCII white space (x20, x09-x0D), and each run of
    ``shingle`` tokens, joined by one space, is hashed by XXH64; fewer tokens make one shingle of the whole sequence.
    A bit is 1 if it is set in over half the hashes. Null, empty and white-space texts give zero. ``distinct`` counts
    each different shingle once. A text is folded in pieces of 2**18 shingles, so the bits of a very long text never
    stand in memory together.
    """
    import numpy as np
    import xxhash

    toks = text.lower().split() if text else []
    if not toks:
        return [0] * words
    if len(toks) <= shingle:
        grams = [b" ".join(toks)]
    else:
        grams = list(map(b" ".join, zip(*(toks[i:] for i in range(shingle)))))
    if distinct:
        grams = list(dict.fromkeys(grams))
    out = []
    for w in range(words):
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED + w)), dtype="<u8", count=len(grams))
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(h), 1 << 18):
            ones += np.unpackbits(h[i : i + (1 << 18)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        bits = np.packbits(ones * 2 > len(h), bitorder="little")
        out.append(int(bits.view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, *keep: str, text: str = "text", shingle: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """The columns ``keep`` of each row and its fingerprint as ``fp0``..; texts are read in bounded Arrow batches."""
    import pyarrow as pa

    names = [f"fp{i}" for i in range(words)]
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(n, T.LongType(), False) for n in names])

    def run(batches):
        worker_cache(None)
        for b in batches:
            got = [fingerprint_words(x.as_py(), shingle, words, distinct) for x in b.column(len(keep))]
            cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(words)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*keep, *names])

    return docs.select(*keep, F.col(text).cast("binary").alias("__text")).mapInArrow(run, schema)


def segments(bits: int, count: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``count`` segments that cover ``bits`` bits, widths at most one apart."""
    out, at = [], 0
    for i in range(count):
        width = bits // count + (i < bits % count)
        out.append((at, width))
        at += width
    return out


def _segment(names: list[str], at: int, width: int) -> Column:
    """Bits ``at``.. of the words, lowest first, as a non-negative long; a segment may lie across two words."""
    w, o = divmod(at, 64)
    low = F.shiftrightunsigned(F.col(names[w]), o)
    if o + width > 64:
        low = low.bitwiseOR(F.shiftleft(F.col(names[w + 1]), 64 - o))
    return low.bitwiseAND(F.lit((1 << width) - 1))


def _distance(names: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.{n}").bitwiseXOR(F.col(f"{b}.{n}"))) for n in names))


def _table(nodes: DataFrame, names: list[str], segs: list[tuple[int, int]], *more: str) -> DataFrame:
    """A row per node and segment: its bucket key holds the segment's number and value."""
    keys = F.array(*(F.lit(i << 54).bitwiseOR(_segment(names, *s)) for i, s in enumerate(segs)))
    return nodes.select(F.explode(keys).alias("key"), "nid", *more, *names)


def _ball(table: DataFrame, segs: list[tuple[int, int]]) -> DataFrame:
    """The keys at one bit from a row's own, by clearing each of its set bits.

    Of two values one bit apart exactly one has that bit, so clearing alone finds each such pair once.
    """
    widest = max(w for _, w in segs)
    bit = "shiftleft(1L, i)"
    keys = F.expr(f"transform(filter(sequence(0, {widest - 1}), i -> (key & {bit}) <> 0), i -> key & ~{bit})")
    return table.withColumn("key", F.explode(keys))


def link(nodes: DataFrame, words: int, radius: int, count: int) -> DataFrame:
    """(nid, root): the component of every node, links being fingerprints at ``radius`` or fewer differing bits.

    ``nodes`` holds ``nid`` (unique) and the words ``fp0``.. of *different* fingerprints. Multi-index hashing: the bits
    are cut into ``count`` segments; each node is filed in a table by the value of each segment, every value in the
    Hamming ball of radius 1 around its segments is looked up there, and the complete distance of what is found is
    verified. With ``radius < 2 * count`` two linked nodes are within one bit in at least one segment, so no link is
    missed; with larger radii the search is approximate and ``count`` sets its recall.

    First each bucket's members are held against its smallest node only, which already joins large groups. Then pairs
    that are not yet in one component are compared in full. Pairs inside a component are never emitted, and buckets
    with over ``DENSE`` members of one component do not even compare these with each other, so a group of copies costs
    in proportion to its size.
    """
    names = [f"fp{i}" for i in range(words)]
    segs = segments(64 * words, count)
    near = _distance(names, "x", "y") <= radius

    table = _table(nodes, names, segs)
    lead = (
        table.groupBy("key").agg(F.min(F.struct("nid", *names)).alias("l"), F.count("*").alias("n"))
        .where("n > 1").select("key", "l.*")
    )
    star = (
        table.alias("x").join(lead.alias("y"), "key")
        .where((F.col("x.nid") != F.col("y.nid")) & near)
        .select(F.col("x.nid").alias("a"), F.col("y.nid").alias("b"))
    )
    first = connected_components(star)
    noted = cut(
        nodes.join(first.withColumnRenamed("node", "nid"), "nid", "left")
        .select("nid", F.coalesce("root", "nid").alias("comp"), *names),
        "noted",
    )

    table = _table(noted, names, segs, "comp")
    probe = table.withColumn("same", F.lit(True)).unionByName(_ball(table, segs).withColumn("same", F.lit(False)))
    fresh = (F.col("x.comp") != F.col("y.comp")) & (~F.col("x.same") | (F.col("x.nid") < F.col("y.nid"))) & near

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & fresh).select(
            F.col("x.comp").alias("a"), F.col("y.comp").alias("b")
        )

    dense = cut(table.groupBy("key", "comp").count().where(F.col("count") > DENSE).select("key", "comp"), "dense")
    if dense.isEmpty():
        more = pairs(probe, table)
    else:
        on = ["key", "comp"]
        crowd = table.join(dense, on, "left_semi")
        several = dense.groupBy("key").count().where(F.col("count") > 1).select("key")
        more = (
            pairs(probe, table.join(dense, on, "left_anti"))
            .union(pairs(probe.join(dense, on, "left_anti"), crowd))
            .union(pairs(probe.join(dense, on, "left_semi").join(several, "key", "left_semi"), crowd))
        )
    second = connected_components(more)
    out = cut(
        noted.join(second.withColumnRenamed("node", "comp"), "comp", "left")
        .select("nid", F.coalesce("root", "comp").alias("root"), *names),
        "linked",
    )
    release(first, noted, dense, second)
    return out


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, words: int = 1, radius: int = 2, count: int = 2, distinct: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, its fingerprint words and ``component_id``, the smallest reachable doc_id.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id belong to the component of
    their fingerprint and never name it, unless all its ids are null (component null). Repeated rows stay repeated.
    Further columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    names = [f"fp{i}" for i in range(words)]
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = cut(fingerprints(src, "doc_id", shingle=shingle, words=words, distinct=distinct), "fingerprints")
    nodes = cut(
        rows.groupBy(*names).agg(F.min("doc_id").alias("low")).withColumn("nid", F.monotonically_increasing_id()), "nodes"
    )
    linked = link(nodes.select("nid", *names), words, radius, count)
    named = nodes.select("nid", "low").join(linked, "nid")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    known = named.join(lows, "root").select(*names, "component_id")
    return rows.join(known, names)


#: Near copies: the words a shingle, the least Jaccard similarity, and the least recall of the segments at it.
SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.97
#: A segment has at least MIN_WIDTH bits, and at least ROOM more than the logarithm of the number of texts.
MIN_WIDTH, ROOM = 24, 6
#: The search radius lies this many standard deviations above the bits at which pairs of the least similarity differ;
#: the second figure is that of the first 64 bits, which are compared while keys are joined.
SPREAD, SPREAD_FIRST = 2.8, 3.5
#: A text is measured against its bucket's middle one if their similarity may be this, so that it can be told from others.
RELATED = 0.5
#: Up to so many ids are broadcast to fetch their texts; more are joined by shuffling.
BROADCAST_IDS = 200_000
#: Rows of texts that stand in memory at a time.
BATCH_ROWS = 1000
#: Pairs that share their second text are dealt into runs of this many.
RUN = 256
#: Words of the masks that tell which shingles of a text its middle lacks; so many bits that few shingles share one.
MASKS = [f"mask{i}" for i in range(4)]


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE):
    """The different shingles of a text as sorted 64-bit hashes; tokens as in ``fingerprint_words``."""
    import numpy as np
    import xxhash

    toks = text.lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh64_intdigest, toks), np.uint64, len(toks))
    if not len(h):
        return h
    size = min(shingle, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def wide_fingerprint(hashes, words: int) -> list[int]:
    """``words`` signed 64-bit integers: a bit is 1 if it is set in over half of the hashes, each mixed anew for a word."""
    import numpy as np

    ones = np.zeros(64 * words, np.int64)
    salt = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[None, :]
    for i in range(0, len(hashes), 4080):  # 16 runs of 255, whose sums fit in a byte
        h = hashes[i : i + 4080, None] ^ salt
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            ones += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8").tolist()


def _summaries(docs: DataFrame, words: int, shingle: int) -> DataFrame:
    """doc_id, digest, size (different shingles) and fingerprint words of ``docs`` (doc_id, digest, text)."""
    import pyarrow as pa

    names = [f"fp{i}" for i in range(words)]
    fields = [docs.schema["doc_id"], docs.schema["digest"]] + [T.StructField(n, T.LongType(), False) for n in ("size", *names)]

    def run(batches):
        worker_cache(None)
        for b in batches:
            rows = []
            for x in b.column(2):
                h = shingle_hashes(x.as_py(), shingle)
                rows.append([len(h), *wide_fingerprint(h, words)])
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(words + 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *cols], names=["doc_id", "digest", "size", *names])
        worker_cache(None)

    return docs.select("doc_id", "digest", F.col("text").cast("binary")).mapInArrow(run, T.StructType(fields))


def differing(similarity: float) -> float:
    """The share of bits at which sets of equal size and this Jaccard similarity differ."""
    from math import acos, pi

    return acos(2 * similarity / (1 + similarity)) / pi


def radius_of(similarity: float, bits: int, spread: float = SPREAD) -> int:
    """The bits at which sets of equal size and this Jaccard similarity differ, and ``spread`` standard deviations."""
    p = differing(similarity)
    return int(bits * p + spread * (bits * p * (1 - p)) ** 0.5)


def segments_for(texts: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(number, width) of the segments for so many texts.

    The width follows the logarithm of their number, so that a text meets as many strangers in a bucket at any size; the
    number is the least at which a pair of that similarity meets within one bit in some segment with a chance of RECALL.
    """
    from math import ceil, log, log2

    width = max(MIN_WIDTH, ceil(log2(max(texts, 2))) + ROOM)
    p = differing(similarity)
    one = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return ceil(log(1 - RECALL) / log(1 - one)), width


def _close(pairs: DataFrame, nodes: DataFrame, names: list[str], radius: int, similarity: float) -> DataFrame:
    """The different (a, b) of ``pairs`` whose sizes allow the similarity and whose complete distance is in the radius."""
    x = nodes.select(F.col("nid").alias("a"), F.col("size").alias("x_size"), F.struct(*names).alias("x"))
    y = nodes.select(F.col("nid").alias("b"), F.col("size").alias("y_size"), F.struct(*names).alias("y"))
    met = pairs.distinct().join(x, "a").join(y, "b")
    alike = F.least("x_size", "y_size") >= F.lit(similarity) * F.greatest("x_size", "y_size")
    return met.where(alike & (_distance(names, "x", "y") <= radius)).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float, limit: int = BROADCAST_IDS) -> DataFrame:
    """The different ``pairs`` (a, b) with ``linked``: whether their sets of shingles have the Jaccard similarity.

    ``more`` and ``less`` count the shingles of a that b lacks, and the reverse; the words ``MASKS`` have a bit, told by its
    hash, for each of the former. Texts are fetched for the nodes in pairs only. Pairs with the same b are dealt into runs of RUN, each with its own
    copy of that text, so that a text near very many others meets them in many tasks.
    """
    import pyarrow as pa

    pairs = cut(pairs, "pairs")
    _let_go(nodes.sparkSession)
    runs = pairs.groupBy("b").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    wanted = pairs.select(F.col("a").alias("nid")).union(pairs.select(F.col("b").alias("nid"))).distinct()
    ids = cut(wanted.join(nodes.select("nid", "doc_id", "digest"), "nid"), "wanted")
    few = F.broadcast(ids) if ids.count() <= limit else ids
    same = F.col("i.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("i.digest") == F.col("t.digest"))
    found = cut(texts.alias("t").join(few.alias("i"), same).select("nid", "text").dropDuplicates(["nid"]), "texts")
    dealt = pairs.join(runs, "b").withColumn("run", F.pmod(F.xxhash64("a"), F.col("runs")))
    left = dealt.join(found.select(F.col("nid").alias("a"), F.col("text").alias("x")), "a")
    right = found.join(runs.withColumnRenamed("b", "nid"), "nid").select(
        F.col("nid").alias("b"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("text").alias("y")
    )
    both = left.withColumn("run", F.col("run").cast("int")).join(right, ["b", "run"]).select("a", "b", "x", "y")

    def run(batches):
        import numpy as np

        worker_cache(None)
        last: tuple = (None, None)
        for batch in batches:
            rows = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if last[0] != b:
                    last = b, shingle_hashes(y.as_py(), shingle)
                h = shingle_hashes(x.as_py(), shingle)
                extra = np.setdiff1d(h, last[1], assume_unique=True)
                shared = len(h) - len(extra)
                bits = np.zeros(64 * len(MASKS), bool)
                bits[extra >> np.uint64(64 - (len(bits) - 1).bit_length())] = True
                linked = shared >= similarity * (len(h) + len(last[1]) - shared)
                rows.append((linked, len(extra), len(last[1]) - shared, *np.packbits(bits, bitorder="little").view("<i8").tolist()))
            kinds = (pa.bool_(), pa.int32(), pa.int32(), *[pa.int64()] * len(MASKS))
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], names=["a", "b", "linked", "more", "less", *MASKS])
        worker_cache(None)

    own = both.select("a", "b", F.col("x").cast("binary").alias("x"), F.col("y").cast("binary").alias("y"))
    schema = ", ".join(["a long, b long, linked boolean, more int, less int", *(f"{m} long" for m in MASKS)])
    out = cut(own.mapInArrow(run, schema), "links", BATCH_ROWS)
    release(pairs, ids, found)
    return out


def _against(measured: DataFrame) -> DataFrame:
    """(nid, pairs, mid, more, less, masks): how each node differs from the busiest of the texts that it was measured
    against, itself included; ``pairs`` counts what was measured against that."""
    busy = measured.groupBy("b").agg(F.count("*").alias("pairs"))
    zero = [F.lit(0).alias("more"), F.lit(0).alias("less"), *(F.lit(0).cast("long").alias(m) for m in MASKS)]
    rows = measured.select("a", "b", "more", "less", *MASKS).union(busy.select(F.col("b").alias("a"), "b", *zero))
    most = F.max(F.struct("pairs", "b", "more", "less", *MASKS)).alias("m")
    return rows.join(busy, "b").groupBy(F.col("a").alias("nid")).agg(most).select("nid", "m.pairs", F.col("m.b").alias("mid"), "m.more", "m.less", *(f"m.{x}" for x in MASKS))


def _apart(a: str, b: str) -> Column:
    """The least number of shingles that only one of two texts has, from how both differ from a third.

    Of the shingles that the third lacks, a has ``more``, at least one for each bit of its masks; at most those whose
    bit is in the masks of both are common. Of the third's shingles a and b lack ``less`` each, and at most all of the fewer are
    lacked by both.
    """
    total = lambda counts: reduce(lambda x, y: x + y, counts)
    both = total(F.bit_count(F.col(f"{a}.{m}").bitwiseAND(F.col(f"{b}.{m}"))) for m in MASKS)
    most = lambda x: F.col(f"{x}.more") - total(F.bit_count(f"{x}.{m}") for m in MASKS) + both
    common = F.least(most(a), most(b))
    return F.col(f"{a}.more") + F.col(f"{b}.more") - 2 * common + F.abs(F.col(f"{a}.less") - F.col(f"{b}.less"))


def _too_far(a: str, b: str, similarity: float) -> Column:
    """Whether ``_apart`` proves a similarity below the least; one that equals it is no proof, however it is rounded."""
    return _apart(a, b) > F.lit((1 - similarity) / (1 + similarity)) * (F.col(f"{a}.size") + F.col(f"{b}.size")) + 1e-6


def _let_go(spark: SparkSession) -> None:
    """Lets go of the shuffles behind tables that are written: nothing reads them again, but they would stay on disk until
    the driver happens to collect its garbage. The first round frees their plans, the second the shuffles."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def link_similar(nodes: DataFrame, texts: DataFrame, words: int, count: int, width: int, shingle: int, similarity: float) -> DataFrame:
    """(node, root) for each node that is not the smallest of its component, links being pairs of that similarity.

    ``nodes`` holds nid (unique), doc_id and digest of a text in ``texts``, size and the words of *different*
    fingerprints. Multi-index hashing, as in ``link``, over ``count`` segments of ``width`` bits; a pair found is held
    against the complete distance and then, exactly, against the sets of shingles. Pairs of the least similarity differ
    in 15 % of the bits, so a segment brings them together with a chance of a tenth; of all segments, 0.97 do. Sets of few
    shingles differ in more bits than that formula says, for an even number of them is often split evenly: 0.93 of pairs of
    12 to 15 shingles meet, but only some 0.5 of those of 5, texts of nine words or fewer. First each node is held against one node of each bucket, that which meets the most others in its
    buckets and so lies in the middle of its group, which joins large groups; then all pairs that meet and lie in
    different components are verified. While keys are joined, the first 64 bits and the sizes are compared, and pairs that
    were measured against the same text are left out if that proves them apart (``_apart``): the many copies of one text
    that differ from each other too much are told so without being paired.
    """
    names = [f"fp{i}" for i in range(words)]
    segs = [(i * width, width) for i in range(count)]
    radius, first_radius = radius_of(similarity, 64 * words), radius_of(similarity, 64, SPREAD_FIRST)

    table = _table(nodes, names, segs).select("key", "nid")
    met = table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(table.join(met, "key"), "shared")
    weight = shared.groupBy("nid").agg(F.sum("n").alias("weight"))
    weighed = shared.select("key", "nid").join(weight, "nid")
    lead = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("nid")).alias("low"))).alias("l"))
    star = shared.join(lead.select("key", (-F.col("l.low")).alias("b")), "key").where("nid <> b").select(F.col("nid").alias("a"), "b")
    related = radius_of(RELATED, 64 * words)
    met_star = _verified(_close(star, nodes, names, related, RELATED), nodes, texts, shingle, similarity)
    _let_go(nodes.sparkSession)
    # Buckets of one group may have different middles: each node is measured against its middle's middle, too.
    up = cut(_against(met_star), "up")
    hop = up.select(F.col("nid").alias("a"), F.col("mid").alias("m")).join(up.select(F.col("nid").alias("m"), F.col("mid").alias("b")), "m")
    hop = hop.where("b <> m AND a <> b").select("a", "b").join(met_star.select("a", "b"), ["a", "b"], "left_anti")
    met_hop = _verified(_close(hop, nodes, names, related, RELATED), nodes, texts, shingle, similarity)
    measured = met_star.union(met_hop)
    links = measured.where("linked").select("a", "b")
    first = connected_components(links)
    _let_go(nodes.sparkSession)
    against = _against(measured).drop("pairs")
    noted = cut(
        nodes.select("nid", "size", *names).join(first.withColumnRenamed("node", "nid"), "nid", "left").join(against, "nid", "left")
        .select("nid", F.coalesce("root", "nid").alias("comp"), F.col("size").cast("int").alias("size"), "mid", "more", "less", *MASKS, *names),
        "noted",
    )

    carried = ["comp", "size", "mid", "more", "less", *MASKS]
    table = _table(noted, names, segs, *carried).select("key", "nid", "fp0", *carried)
    # A key from the ball has a negative nid: such pairs are found once, those of equal keys twice.
    probe = table.union(_ball(table, segs).select("key", (-F.col("nid") - 1).alias("nid"), "fp0", *carried))
    fresh = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.nid") < F.col("y.nid"))
    fresh &= F.least("x.size", "y.size") >= F.lit(similarity) * F.greatest("x.size", "y.size")
    fresh &= F.bit_count(F.col("x.fp0").bitwiseXOR(F.col("y.fp0"))) <= first_radius
    fresh &= ~F.coalesce((F.col("x.mid") == F.col("y.mid")) & _too_far("x", "y", similarity), F.lit(False))

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        a = F.when(F.col("x.nid") < 0, -F.col("x.nid") - 1).otherwise(F.col("x.nid"))
        met = x.alias("x").join(y.alias("y"), fresh)
        return met.select(F.greatest(a, "y.nid").alias("a"), F.least(a, "y.nid").alias("b"))

    dense = cut(table.groupBy("key", "comp").count().where(F.col("count") > DENSE).select("key", "comp"), "dense")
    _let_go(nodes.sparkSession)
    if dense.isEmpty():
        more = pairs(probe, table)
    else:
        on = ["key", "comp"]
        crowd = table.join(dense, on, "left_semi")
        several = dense.groupBy("key").count().where(F.col("count") > 1).select("key")
        there = probe.join(dense.select("key").distinct(), "key", "left_semi")
        more = (
            pairs(probe, table.join(dense, on, "left_anti"))
            .union(pairs(there.join(dense, on, "left_anti"), crowd))
            .union(pairs(there.join(dense, on, "left_semi").join(several, "key", "left_semi"), crowd))
        )
    late = _verified(_close(more, nodes, names, radius, similarity), nodes, texts, shingle, similarity)
    _let_go(nodes.sparkSession)
    out = connected_components(links.union(late.where("linked").select("a", "b")))
    release(shared, met_star, up, met_hop, first, noted, dense, late)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest doc_id stays, with all its columns.

    Two documents are near copies if their sets of five-word shingles have a Jaccard similarity of at least
    ``similarity``; groups are the components of these links. Links are searched by ``link_similar``, whose recall is
    that of its segments, and each is verified on the sets. Documents without a word are copies of each other only. Rows
    with a null id come after all others; of equal rows one stays. ``docs`` needs doc_id and text; other columns may have
    any names. An empty table gives an empty result.
    """
    count, width = segments_for(docs.count(), similarity)
    words = -(-count * width // 64)
    names = [f"fp{i}" for i in range(words)]
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    src = docs.select("doc_id", digest.alias("digest"), "text")
    rows = cut(_summaries(src, words, shingle), "summaries", BATCH_ROWS)
    late = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "digest")
    nodes = rows.where("size > 0").groupBy("size", *names).agg(F.min(late).alias("k"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("nid"), "k.doc_id", "k.digest", "size", *names), "nodes")
    linked = link_similar(nodes, src, words, count, width, shingle, similarity)
    # Of the groups' first rows only the smallest stays; a row that is not its node's first went before.
    firsts = nodes.join(linked.withColumnRenamed("node", "nid"), "nid", "left").select(F.coalesce("root", "nid").alias("root"), "doc_id", "digest")
    firsts = firsts.union(rows.where("size = 0").select(F.lit(-1).cast("long").alias("root"), "doc_id", "digest"))
    keep = firsts.groupBy("root").agg(F.min(late).alias("k")).select("k.doc_id", "k.digest")
    keep = cut(keep, "keep")
    twice = not rows.groupBy("doc_id", "digest").count().where("count > 1").isEmpty()
    release(rows, nodes, linked)
    mark = "digest"
    while mark in docs.columns:
        mark += "_"
    kept = docs.withColumn(mark, digest).alias("d").join(
        keep.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{mark}") == F.col("k.digest")), "left_semi"
    )
    kept = kept.dropDuplicates(["doc_id", mark]) if twice else kept
    return holding(kept.drop(mark), keep)
