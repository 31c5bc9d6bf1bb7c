"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.storage import cut, holding, release

#: Group sizes below 2**EXACT are packed exactly, larger ones as rounded up to EXACT significant bits; so there are at
#: most 2**EXACT * (64 - EXACT) size classes whatever the input, and only these come to the driver.
EXACT = 12
#: Rows that one task numbers at a time.
RUN = 50_000


class Tree:
    """A treap of (remaining, bin): ordered by key, heap-ordered by a hash of the bin, so its depth is logarithmic."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _rank(key: tuple[int, int]) -> int:
        return key[1] * 0x9E3779B97F4A7C15 % (1 << 64) ^ key[1] >> 7

    def add(self, key: tuple[int, int]) -> None:
        def split(t, k):
            if t is None:
                return None, None
            if t[0] < k:
                t[2], right = split(t[2], k)
                return t, right
            left, t[1] = split(t[1], k)
            return left, t

        rank = self._rank(key)
        over, t, right = None, self.root, False
        while t is not None and t[3] > rank:
            over, right = t, t[0] < key
            t = t[2] if right else t[1]
        left, rest = split(t, key)
        node = [key, left, rest, rank]  # key, left, right, rank
        if over is None:
            self.root = node
        else:
            over[2 if right else 1] = node

    def pop_least(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """Takes out the smallest entry that is not below ``key``."""
        best, over, t, parent = None, None, self.root, None
        while t is not None:
            if t[0] < key:
                parent, t = t, t[2]
            else:
                best, over = t, parent
                parent, t = t, t[1]
        if best is None:
            return None

        def merge(a, b):
            if a is None or b is None:
                return a if b is None else b
            if a[3] > b[3]:
                a[2] = merge(a[2], b)
                return a
            b[1] = merge(a, b[1])
            return b

        rest = merge(best[1], best[2])
        if over is None:
            self.root = rest
        else:
            over[1 if over[1] is best else 2] = rest
        return best[0]


class Bins:
    """Open bins in a balanced tree by remaining capacity, in which the tightest that still takes a size is found."""

    def __init__(self, capacity: int, count: int | None = None):
        self.capacity, self.count, self.opened = capacity, count, 0
        self.tree = Tree()

    def put(self, size: int, n: int) -> list[tuple[int, int]] | None:
        """Places ``n`` groups of one size; [(bin, how many)] or None if a fixed number of bins doesn't suffice.

        The bin that takes a group becomes tighter, so it stays the tightest for the next one of that size until it is
        full: a run of equal groups is placed at once.
        """
        out = []
        while n:
            found = self.tree.pop_least((size, -1))
            if found:
                left, b = found
            elif size <= self.capacity and (self.count is None or self.opened < self.count):
                left, b = self.capacity, self.opened
                self.opened += 1
            else:
                return None
            k = min(n, left // size)
            out.append((b, k))
            self.tree.add((left - k * size, b))
            n -= k
        return out


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, count: int | None = None):
    """[(size, bin, how many)] for (size, number of groups) pairs; None if ``count`` bins don't suffice."""
    bins, out = Bins(capacity, count), []
    for size, n in sorted(sizes, reverse=True):
        put = bins.put(size, n)
        if put is None:
            return None
        out += [(size, b, k) for b, k in put]
    return out


def pack_into(sizes: list[tuple[int, int]], count: int):
    """The packing into at most ``count`` bins: groups above the mean alone, the others as evenly as they go.

    From the largest on, a group above the mean of what is left over the bins left gets a bin of its own. For the others
    a small capacity at which best-fit-decreasing fills the bins left is found by bisection, between their mean (or
    their largest group) and a bound at which any order fits. (A larger capacity may, rarely, need more bins, so a still
    smaller one can exist.)
    """
    sizes = sorted(((s, n) for s, n in sizes if n), reverse=True)
    alone = []
    total, used = sum(s * n for s, n in sizes), 0
    while sizes and used + 1 < count and sizes[0][0] * (count - used) > total:
        s, n = sizes[0]
        # Taking a group of size s away lowers the mean, so the test stays true for all of that size.
        k = min(n, count - 1 - used)
        alone += [(s, used + i, 1) for i in range(k)]
        used, total = used + k, total - s * k
        sizes = [(s, n - k)] * (n > k) + sizes[1:]
    if not sizes:
        return alone
    count -= used
    low = max(-(-total // count), sizes[0][0])
    high = low + sizes[0][0]
    best = best_fit_decreasing(sizes, high, count)
    while best is None:
        high *= 2
        best = best_fit_decreasing(sizes, high, count)
    while low < high:
        mid = (low + high) // 2
        got = best_fit_decreasing(sizes, mid, count)
        if got is None:
            low = mid + 1
        else:
            high, best = mid, got
    return alone + [(s, b + used, k) for s, b, k in best]


def size_class(size: Column) -> Column:
    """The size packed for a group: itself below 2**EXACT, else rounded up to EXACT significant bits."""
    drop = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int") - (EXACT - 1))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), drop)
    return F.ceil(size / unit).cast("long") * unit


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``, a gapless number from 0 within the columns ``by``, without one task per value of ``by``.

    Rows are dealt by ``by`` and a hash of ``order`` into runs of about RUN rows; runs are numbered by windows and
    shifted by the running sum of the runs' counts, a table of one row per run. ``by`` must have few values (size
    classes, shards): their counts are broadcast.
    """
    counts = df.groupBy(*by).agg(F.count("*").alias("__n")).withColumn("__runs", F.ceil(F.col("__n") / RUN).cast("long"))
    part = F.pmod(F.xxhash64(*order), F.col("__runs"))
    dealt = df.join(F.broadcast(counts.drop("__n")), by).withColumn("__run", part).drop("__runs")
    runs = dealt.groupBy(*by, "__run").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(*by, "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(*by, "__run").orderBy(*order)) - 1
    return (
        dealt.withColumn("__at", within).join(starts, [*by, "__run"])
        .withColumn(name, (F.col("__start") + F.col("__at")).cast("long")).drop("__run", "__at", "__start")
    )


#: Ranges of groups (a class, a shard and its groups; some 40 bytes each) up to which they are broadcast.
BROADCAST_RANGES = 500_000


def _placed(rows: DataFrame, key: str, size: str, pack, most: int | None = None) -> DataFrame:
    """``rows`` with the shard that ``pack``, from [(class, groups)] to [(class, shard, groups)], gives their group.

    A group of ``most`` bytes or less is in no class above that. A group finds its range by its number in its class:
    ranges are filed under blocks of their class's mean length, so a class of many ranges does not meet all of them.
    """
    spark = rows.sparkSession
    own = size_class(F.col("bytes"))
    if most is not None:
        own = F.when(F.col("bytes") <= most, F.least(own, F.lit(most).cast("long"))).otherwise(own)
    groups = cut(rows.groupBy(key).agg(F.sum(size).alias("bytes")).select(F.col(key).alias("__key"), own.alias("__class")), "groups")
    classes = [(r[0], r[1]) for r in groups.groupBy("__class").count().collect()]
    at: dict[int, int] = {}
    ranges = []
    for s, b, k in pack(classes):
        lo = at.get(s, 0)
        ranges.append((s, lo, lo + k, b))
        at[s] = lo + k
    many: dict[int, int] = {}
    for s, *_ in ranges:
        many[s] = many.get(s, 0) + 1
    steps = [(s, -(-at[s] // n)) for s, n in many.items() if at[s]]
    small = len(ranges) <= BROADCAST_RANGES
    hint = F.broadcast if small else lambda df: df
    steps = spark.createDataFrame(steps, "__class long, __step long")
    places = spark.createDataFrame([r for r in ranges if r[2] > r[1]], "__class long, __lo long, __hi long, shard int").join(F.broadcast(steps), "__class")
    block = lambda c: F.floor(F.col(c) / F.col("__step"))
    places = places.withColumn("__block", F.explode(F.sequence(block("__lo"), F.floor((F.col("__hi") - 1) / F.col("__step"))))).drop("__step")
    rank = numbered(groups, ["__class"], ["__key"], "__rank").join(F.broadcast(steps), "__class").withColumn("__block", block("__rank"))
    inside = (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi"))
    placed = rank.join(hint(places), ["__class", "__block"]).where(inside).select(F.col("__key").alias(key), "shard")
    out = cut(rows.join(placed, key), "placed")
    release(groups)
    return out


def shard(rows: DataFrame, key: str = "group", size: str = "size", count: int = 24, order: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``count`` - 1) and ``slot`` (gapless from 0 in each shard).

    Rows with equal ``key`` form one group, and a group goes to one shard whole. Groups are summed (combined before the
    shuffle), counted by size class, and the classes - at most 2**EXACT * (64 - EXACT) rows, however large the input -
    are packed on the driver by best-fit-decreasing; groups of one class are interchangeable, so each takes the place of
    its number within the class. From 2**EXACT bytes on a group counts as up to 1/2048 larger than it is. A group larger
    than the mean of the shards left has a shard of its own, and the others are spread evenly over the rest. ``key`` and
    ``size`` must not be null; ``order`` makes the numbering repeatable. An empty table gives an empty result.
    """
    out = _placed(rows, key, size, lambda classes: pack_into(classes, count))
    return holding(numbered(out, ["shard"], list(order) or [key], "slot"), out)


def shard_to_capacity(rows: DataFrame, capacity: int, key: str = "group", size: str = "size", order: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, in as few shards of ``capacity`` bytes as best-fit-decreasing finds.

    As ``shard``, but the capacity is fixed and the number of shards follows. No shard exceeds the capacity; a group that
    does raises ValueError.
    """

    def pack(classes):
        got = best_fit_decreasing(classes, capacity)
        if got is None:
            raise ValueError(f"a group is larger than {capacity} bytes")
        return got

    out = _placed(rows, key, size, pack, capacity)
    return holding(numbered(out, ["shard"], list(order) or [key], "slot"), out)


def shard_documents(docs: DataFrame, count: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text and 8), text_crc32, shard and slot.

    Groups are equal texts, told by their SHA-256; a null text counts as an empty one. Only ids, sizes and digests are
    shuffled, never texts. Repeated rows stay repeated, each with a slot of its own.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("group"),
    )
    rows = cut(rows, "rows")
    placed = shard(rows, "group", "size", count, ("doc_id", "group"))
    release(rows)
    return placed
