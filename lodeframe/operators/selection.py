"""Choice of frames: sharpness against a recording's own, samples, gaps, bands, anchors, and trims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.operators.frames import runs
from lodeframe.session import spread


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def sharp_enough(df: DataFrame, by: str, sharp: str, share: float = 0.8) -> DataFrame:
    """``enough``: at least that share of the nearest-rank 95th percentile of its key; ``spread``: the 5th over the 95th.

    Frames without a measure are not enough and do not count.
    """
    w = Window.partitionBy(by)
    known = df.where(F.col(sharp).isNotNull()).select(by, F.col(sharp).alias("__v"))
    known = known.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy("__v")) - 1)
    rank = lambda p: F.max(F.when(F.col("__r") == _half_up((F.col("__n") - 1) * p), F.col("__v")))
    stats = known.groupBy(by).agg(rank(0.95).alias("__high"), rank(0.05).alias("__low"))
    out = df.join(stats, by, "left")
    enough = F.coalesce(F.col(sharp) >= F.col("__high") * share, F.lit(False))
    spread = F.when(F.col("__high") > 0, F.col("__low") / F.col("__high")).otherwise(0.0)
    return out.withColumn("enough", enough).withColumn("spread", spread).drop("__high", "__low")


def blurriest(df: DataFrame, by: str, sharp: str, tie: str, share: float = 0.15, most: int = 30) -> DataFrame:
    """The least sharp share of each key's measured frames, at least one, thinned evenly to at most ``most``; ``place`` from 0."""
    w = Window.partitionBy(by)
    at = df.where(F.col(sharp).isNotNull()).withColumn("__n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(sharp, tie)) - 1)
    low = F.greatest(F.lit(1), _half_up(F.col("__n") * share))
    return at.where((F.col("place") < low) & (F.col("place") % F.ceil(low / most) == 0)).drop("__n")


def kept_gaps(df: DataFrame, by: str, order: str, position: str, kept: Column) -> DataFrame:
    """(by, max_gap, total): the largest step between consecutive kept frames, and the way from the first frame to the last."""
    step = F.abs(F.col(position) - F.lag(position).over(Window.partitionBy(by).orderBy(order)))
    gaps = df.where(kept).withColumn("__g", step).groupBy(by).agg(F.max("__g").alias("max_gap"))
    total = df.groupBy(by).agg(F.abs(F.max_by(position, order) - F.min_by(position, order)).alias("total"))
    return total.join(gaps, by, "left").select(by, F.coalesce("max_gap", F.lit(0)).alias("max_gap"), "total")


def robust_band(found: DataFrame, by: str, start: str, end: str, height: float, share: float = 0.02) -> DataFrame:
    """(by, start, end): the upper median of the starts, and the largest end of those that start near it."""
    w = Window.partitionBy(by)
    at = found.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(start)) - 1)
    mid = at.where(F.col("__r") == F.floor(F.col("__n") / 2)).select(by, F.col(start).alias("__mid"))
    near = found.join(mid, by).where(F.abs(F.col(start) - F.col("__mid")) <= int(height * share + 0.5))
    return near.groupBy(by).agg(F.first("__mid").alias("start"), F.max(end).alias("end"))


def pick_anchors(heads: DataFrame, group: list[str], near: float) -> DataFrame:
    """One head a group, of those within ``near`` of its topmost (``place``): in the window and still before only in the
    window before others; then the highest on the screen (``y``), then the earliest (``t``). Columns in_window, still."""
    w = Window.partitionBy(*group)
    rank = F.when(F.col("in_window") & F.col("still"), 0).when(F.col("in_window"), 1).otherwise(2)
    top = heads.withColumn("__top", F.min("place").over(w)).where(F.col("place") - F.col("__top") <= near)
    return top.withColumn("__k", F.row_number().over(w.orderBy(rank, "y", "t"))).where("__k = 1").drop("__top", "__k")


def trim_overscroll(df: DataFrame, by: str, order: str, position: str, still: Column, height: float, least: float) -> DataFrame:
    """Frames without those that went past the last still frame and came back.

    Only where no frame after the last still one lies over ``least`` beyond it, and none anywhere over a quarter of the
    height: then moving frames, but for the first, go if they lie over 0.06 of the height beyond it.
    """
    w = Window.partitionBy(by)
    at = df.withColumn("__still", F.coalesce(still, F.lit(False)))
    last = F.max(F.when(F.col("__still"), F.struct(F.col(order).alias("o"), F.col(position).alias("p")))).over(w)
    at = at.withColumn("__last", last).withColumn("__most", F.max(position).over(w)).withColumn("__first", F.min(order).over(w))
    at = at.withColumn("__after", F.max(F.when(F.col(order) > F.col("__last.o"), F.col(position))).over(w))
    rest = F.col("__last.p")
    judged = F.coalesce(F.col("__after") <= rest + least, F.lit(True)) & (F.col("__most") - rest <= height * 0.25)
    gone = judged & ~F.col("__still") & (F.col(order) > F.col("__first")) & (F.col(position) > rest + int(height * 0.06 + 0.5))
    return at.where(~F.coalesce(gone, F.lit(False))).drop("__still", "__last", "__most", "__first", "__after")


def agreeing_span(samples: DataFrame, by: str, at: str, box: list[str], agreed: DataFrame, duration: str, every: float, tolerance: float = 2) -> DataFrame:
    """(by, t0, t1): from the first to the last sample whose box agrees with the agreed one, plus one period; spans under
    a second are left out. ``agreed``: by, the box and the duration."""
    ref = agreed.select(by, duration, *(F.col(c).alias(f"__{c}") for c in box))
    same = F.lit(True)
    for c in box:
        same &= F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance
    hit = samples.join(ref, by).where(same)
    span = hit.groupBy(by).agg(F.greatest(F.lit(0.0), F.min(at)).alias("t0"), F.least(F.first(duration), F.max(at) + every).alias("t1"))
    return span.where(F.col("t1") - F.col("t0") >= 1)


def first_quiet(df: DataFrame, by: str, pos: str, on: Column, least: int) -> DataFrame:
    """(by, a, b): the first stretch of ``least`` or more positions where ``on`` does not hold."""
    long = runs(df, [by], pos, ~F.coalesce(on, F.lit(False))).where(F.col("n") >= least)
    return long.groupBy(by).agg(F.min(F.struct("a", "b")).alias("r")).select(by, "r.a", "r.b")


def first_column(blocks: DataFrame, columns: DataFrame, by: str, x: str, key: str, no: str, reach: float) -> DataFrame:
    """(by, key, no): each block's first column, in the order of ``no``, whose ``x`` is within ``reach``; others are dropped.

    Columns are filed by cells of that width, and a block looks into its own and both neighbours.
    """
    cell = F.floor(F.col(x) / reach)
    c = columns.select(by, F.col(x).alias("__x"), no, cell.alias("__c"))
    b = blocks.select(by, x, key, F.explode(F.array(cell - 1, cell, cell + 1)).alias("__c"))
    return b.join(c, [by, "__c"]).where(F.abs(F.col(x) - F.col("__x")) <= reach).groupBy(by, key).agg(F.min(no).alias(no))


def rectangles_meet(left: DataFrame, right: DataFrame, by: str, width: float, height: float) -> DataFrame:
    """Pairs (lk, rk) of rectangles (k, x0, y0, x1, y1) that overlap; touching ones do not.

    Rectangles are filed under the cells that they cover; a pair is reported in the cell of the corner of its common part.
    The pairs can be many times the rectangles, so cells are spread over as many tasks as shuffles have.
    """
    across = lambda c, size: F.floor(c / size)

    def filed(df: DataFrame, s: str) -> DataFrame:
        cells = [F.sequence(across(F.col(f"{a}0"), n), across(F.col(f"{a}1"), n)) for a, n in (("x", width), ("y", height))]
        out = df.withColumn("cx", F.explode(cells[0])).withColumn("cy", F.explode(cells[1]))
        return out.select(by, "cx", "cy", *(F.col(c).alias(f"{s}{c}") for c in ("k", "x0", "y0", "x1", "y1")))

    cell = [by, "cx", "cy"]
    m = spread(filed(left, "l"), *cell).join(spread(filed(right, "r"), *cell), cell)
    here = (F.col("cx") == across(F.greatest("lx0", "rx0"), width)) & (F.col("cy") == across(F.greatest("ly0", "ry0"), height))
    meet = (F.col("lx0") < F.col("rx1")) & (F.col("rx0") < F.col("lx1")) & (F.col("ly0") < F.col("ry1")) & (F.col("ry0") < F.col("ly1"))
    return m.where(here & meet).select(by, "lk", "rk")
