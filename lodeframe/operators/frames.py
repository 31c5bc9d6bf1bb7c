"""Ordered samples: runs, stillness, positions, anchors, and joins by nearness."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.storage import cut, holding, release


def first_per_slot(df: DataFrame, by: str, at: str, width: str, order: list[str]) -> DataFrame:
    """The first sample of each tumbling window: ``slot`` and the row."""
    slot = F.window(at, width)["start"].alias("slot")
    cols = [c for c in df.columns if c != by]
    return df.groupBy(by, slot).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__f")).select(by, "slot", "__f.*")


def runs(df: DataFrame, by: list[str], pos: str, on: Column, gap: int = 0) -> DataFrame:
    """(by, a, b, n): stretches where ``on`` holds, joined across at most ``gap`` positions where it does not; b inclusive."""
    hit = df.where(on)
    w = Window.partitionBy(*by).orderBy(pos)
    new = F.coalesce(F.col(pos) - F.lag(pos).over(w) > gap + 1, F.lit(True)).cast("int")
    marked = hit.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__run").agg(F.min(pos).alias("a"), F.max(pos).alias("b"), F.count("*").alias("n")).drop("__run")


def longest_run(found: DataFrame, by: str) -> DataFrame:
    """The longest stretch of each key, the first of equals."""
    length = F.col("b") - F.col("a") + 1
    return found.groupBy(by).agg(F.max_by(F.struct("a", "b"), F.struct(length, -F.col("a"))).alias("r")).select(by, "r.a", "r.b")


def still_segments(df: DataFrame, by: str, at: str, value: str, limit: float, least: int = 2) -> DataFrame:
    """(by, start, end, n): stretches of consecutive samples whose change stays below ``limit``, of ``least`` or more."""
    w = Window.partitionBy(by).orderBy(at)
    moved = F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)) >= limit, F.lit(True)).cast("int")
    seg = df.withColumn("__m", moved).withColumn("__s", F.sum("__m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = seg.groupBy(by, "__s").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("__s")


def positions(df: DataFrame, by: str, order: list[str], shift: str) -> DataFrame:
    """``position``: the running sum of the shifts, a null shift standing still."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("position", F.sum(F.coalesce(F.col(shift), F.lit(0))).over(w))


def next_gap(df: DataFrame, by: str, order: list[str], pos: str) -> DataFrame:
    """``gap`` to the next row; the last row takes the median of the others."""
    g = F.lead(pos).over(Window.partitionBy(by).orderBy(*order)) - F.col(pos)
    out = df.withColumn("__g", g)
    mid = out.groupBy(by).agg(F.median("__g").alias("__mid"))
    return out.join(mid, by).withColumn("gap", F.coalesce("__g", "__mid")).drop("__g", "__mid")


def take_while(df: DataFrame, by: str, order: list[str], good: Column) -> DataFrame:
    """The rows of each key before the first that is not good; later good ones go too."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__bad", F.max(F.when(F.coalesce(good, F.lit(False)), 0).otherwise(1)).over(w)).where("__bad = 0").drop("__bad")


def prefix_min(df: DataFrame, by: str, order: list[str], value: str, name: str = "low") -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.min(value).over(w))


def best_and_rival(df: DataFrame, by: str, pos: str, cost: str, apart: int = 40) -> DataFrame:
    """(by, at, best, rival): the place of least cost (the first of equals) and the least cost further than ``apart`` from it."""
    best = df.groupBy(by).agg(F.min_by(F.struct(F.col(pos).alias("at"), F.col(cost).alias("best")), F.struct(cost, pos)).alias("b"))
    return (
        df.join(best, by).groupBy(by).agg(
            F.first("b.at").alias("at"), F.first("b.best").alias("best"), F.min(F.when(F.abs(F.col(pos) - F.col("b.at")) > apart, F.col(cost))).alias("rival")
        )
    )


def anchor_segments(df: DataFrame, by: str, order: list[str], anchor: Column) -> DataFrame:
    """``segment``: how many anchors have come up to each row; 0 before the first."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(F.when(anchor, 1).otherwise(0)).over(w))


def nearest(left: DataFrame, right: DataFrame, by: str, at: str, to: str, key: str, tie: str) -> DataFrame:
    """Every left row (``key``) with the right row of the same ``by`` whose ``to`` is nearest to its ``at``; of equals the smaller ``tie``.

    As-of in both directions over the sorted union of both sides, so the work is linear and no pair is formed.
    """
    a = left.select(by, F.col(at).alias("x"), F.col(key).alias("k"), F.lit(None).cast(right.schema[tie].dataType).alias("t"))
    b = right.groupBy(by, F.col(to).alias("x")).agg(F.min(tie).alias("t")).select(by, "x", F.lit(None).cast(left.schema[key].dataType).alias("k"), "t")
    both = a.unionByName(b)
    spot = F.when(F.col("t").isNotNull(), F.struct("x", "t"))
    w = Window.partitionBy(by).orderBy("x")
    back = F.last(spot, True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first(spot, True).over(w.rangeBetween(0, Window.unboundedFollowing))
    met = both.withColumn("p", back).withColumn("n", ahead).where("k IS NOT NULL")
    dp, dn = F.col("x") - F.col("p.x"), F.col("n.x") - F.col("x")
    take_p = F.col("n").isNull() | (dp < dn) | ((dp == dn) & (F.col("p.t") <= F.col("n.t")))
    won = F.when(F.col("p").isNotNull() & take_p, F.col("p")).otherwise(F.col("n"))
    return met.select(by, F.col("k").alias(key), won["t"].alias(tie), F.abs(won["x"] - F.col("x")).alias("distance"))


def overlapping(left: DataFrame, right: DataFrame, by: str, width: float) -> DataFrame:
    """Pairs (lk, rk) whose intervals (a, b) overlap, joined on cells of ``width`` and reported in their first common cell."""
    cell = lambda c: F.floor(F.col(c) / width)
    each = lambda df, k: df.select(by, F.col("k").alias(k), F.col("a").alias(f"{k}_a"), F.col("b").alias(f"{k}_b"), F.explode(F.sequence(cell("a"), cell("b"))).alias("cell"))
    m = each(left, "lk").join(each(right, "rk"), [by, "cell"])
    first = F.floor(F.greatest("lk_a", "rk_a") / width)
    return m.where((F.col("lk_a") <= F.col("rk_b")) & (F.col("rk_a") <= F.col("lk_b")) & (F.col("cell") == first)).select(by, "lk", "rk")


def next_start(left: DataFrame, right: DataFrame, by: str, limit: float) -> DataFrame:
    """For each left interval (k, b) the first right one (k, a) that starts within ``limit`` after its end, of equals the smaller k."""
    a = left.select(by, F.col("b").alias("x"), F.col("k").alias("lk"), F.lit(None).cast(right.schema["k"].dataType).alias("rk"))
    b = right.groupBy(by, F.col("a").alias("x")).agg(F.min("k").alias("rk")).select(by, "x", F.lit(None).cast(left.schema["k"].dataType).alias("lk"), "rk")
    spot = F.when(F.col("rk").isNotNull(), F.struct("x", "rk"))
    w = Window.partitionBy(by).orderBy("x").rangeBetween(0, Window.unboundedFollowing)
    met = a.unionByName(b).withColumn("n", F.first(spot, True).over(w)).where("lk IS NOT NULL")
    return met.where(F.col("n.x") - F.col("x") <= limit).select(by, "lk", F.col("n.rk").alias("rk"))


def clusters(df: DataFrame, by: str, value: str, gap: float, least: int = 3) -> DataFrame:
    """(by, low, high, n): values clustered where neighbours are at most ``gap`` apart, of ``least`` or more."""
    w = Window.partitionBy(by).orderBy(value)
    new = F.coalesce(F.col(value) - F.lag(value).over(w) > gap, F.lit(True)).cast("int")
    c = df.withColumn("__n", new).withColumn("__c", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = c.groupBy(by, "__c").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("__c")


def anchored_groups(df: DataFrame, by: str, order: str, value: str, tolerance: float) -> DataFrame:
    """``grp``: rows stay in a group while they are within ``tolerance`` of its first row. A fold, so one key is one group."""
    schema = f"{by} {df.schema[by].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, {value} double, grp int"

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order, kind="stable")
        out, first, g = [], None, -1
        for v in t[value]:
            if first is None or abs(v - first) > tolerance:
                first, g = v, g + 1
            out.append(g)
        return t.assign(grp=out)[[by, order, value, "grp"]]

    return df.select(by, order, F.col(value).cast("double").alias(value)).groupBy(by).applyInPandas(run, schema)


def best_of_group(df: DataFrame, by: list[str], good: Column, sharp: str, pos: str) -> DataFrame:
    """Of each group the sharpest good row, else the sharpest; the first of equals."""
    cols = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(good, F.col(sharp), -F.col(pos))).alias("__b")).select(*by, "__b.*")


def refined(dense: DataFrame, by: str, index: str, value: str, step: int, limit: float) -> DataFrame:
    """(by, index, value): every ``step``-th sample of each key, and between them as many as it takes to measure moves.

    A move of more than ``limit`` between neighbouring samples, or one that has no value, cannot be measured; the sample
    half way is then taken, too, until the halves can or nothing lies between. Samples are numbered from 0 without
    gaps. Each round works on the list of halves that are still open, all keys at once, and ends when that is empty.
    """
    s = dense.select(by, F.col(index).alias("i"), F.col(value).alias("v"))
    first = s.where(F.col("i") % step == 0)
    order = Window.partitionBy(by).orderBy("i")
    spans = first.select(by, F.col("i").alias("a"), F.col("v").alias("va"), F.lead("i").over(order).alias("b"), F.lead("v").over(order).alias("vb")).where("b IS NOT NULL")
    bad = (F.col("b") - F.col("a") > 1) & ~F.coalesce(F.abs(F.col("vb") - F.col("va")) <= limit, F.lit(False))
    found, todo = [first], cut(spans.where(bad), "open")
    while not todo.isEmpty():
        mid = todo.withColumn("i", F.floor((F.col("a") + F.col("b")) / 2)).join(s, [by, "i"])
        mid = cut(mid, "halved")
        found.append(holding(mid.select(by, "i", "v"), mid))
        low = mid.select(by, "a", "va", F.col("i").alias("b"), F.col("v").alias("vb"))
        high = mid.select(by, F.col("i").alias("a"), F.col("v").alias("va"), "b", "vb")
        release(todo)
        todo = cut(low.unionByName(high).where(bad), "open")
    out = reduce(DataFrame.unionByName, found).select(by, F.col("i").alias(index), F.col("v").alias(value))
    return holding(out, *found[1:], todo)


def clip(df: DataFrame, cut: float) -> DataFrame:
    """Intervals (a, b) cut off at ``cut``; those that begin there or later go."""
    return df.where(F.col("a") < cut).withColumn("b", F.least(F.col("b"), F.lit(cut)))


def probes(df: DataFrame, by: str, order: list[str], blank: Column, count: int = 8) -> DataFrame:
    """``count`` samples at even places of each key; a blank one gives way to the next that is not."""
    w = Window.partitionBy(by).orderBy(*order)
    n = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(by)))
    full = n.withColumn("__own", F.when(~F.coalesce(blank, F.lit(False)), F.col("__i")))
    full = full.withColumn("__use", F.first("__own", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    picks = full.select(by, "__i", "__n", "__use").where("__use IS NOT NULL")
    share = F.floor((F.col("__i") * count + F.col("__n") - 1) / F.col("__n"))
    at = F.floor(share * F.col("__n") / count)
    chosen = picks.where((at == F.col("__i")) & (share < count)).select(by, F.col("__use").alias("__i")).distinct()
    return n.join(chosen, [by, "__i"]).drop("__i", "__n")
