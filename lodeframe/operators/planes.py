"""Planes of pixels as tables of runs: colour masks, rows and blocks of text, connected parts, fixed edges of screens.

A plane is a set of pixel rows (key, y, values). Masks are kept as runs, the stretches of a row where they hold, so that
profiles, unions and boxes are sums and windows over a few intervals a row, whatever the size of a plane, and planes of
all sizes are worked on together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.functions import kernels
from lodeframe.operators.components import connected
from lodeframe.storage import cut, holding


def runs_of(rows: DataFrame, by: list[str], y: str, values: str, on: Callable[[Column], Column]) -> DataFrame:
    """(by, y, x0, x1): the stretches, ends included, of each pixel row where ``on`` holds; null pixels never do."""
    m = rows.select(*by, F.col(y).alias("y"), F.transform(values, lambda v: F.coalesce(on(v), F.lit(False))).alias("m"))
    at = F.sequence(F.lit(0), F.size("m") - 1)
    hit = lambda i: F.coalesce(F.get("m", i), F.lit(False))
    edge = lambda step: F.filter(at, lambda i: hit(i) & ~F.when(i + step >= 0, hit(i + step)).otherwise(False))
    ends = m.where(F.size("m") > 0).select(*by, "y", F.arrays_zip(edge(-1).alias("x0"), edge(1).alias("x1")).alias("r"))
    return ends.select(*by, "y", F.explode("r").alias("r")).select(*by, "y", "r.x0", "r.x1")


def colour_masks(dark: int = 80) -> dict[str, Callable[[Column], Column]]:
    """Masks of pixels (r, g, b): green and blue by hue among clear and bright ones, gold, and dark by luma rounded down."""

    def parts(p: Column):
        r, g, b = (p[c].cast("double") for c in "rgb")
        most, least = F.greatest(r, g, b), F.least(r, g, b)
        return r, g, b, most, most - least

    def hue(of: str, turn: int, low: float, high: float):
        def on(p: Column) -> Column:
            r, g, b, most, spread = parts(p)
            clear = (spread > 0) & (most >= 90) & (spread / most >= 0.35)
            ahead = (b - r) if of == "g" else (r - g)
            angle = 60 * (turn + ahead / F.when(spread > 0, spread))
            return clear & (most == p[of]) & (angle >= low) & (angle <= high)

        return on

    # The ranges of hue, the levels of gold and the weights of luma decide what is found.
    return {
        "green": hue("g", 2, 65, 170), "blue": hue("b", 4, 180, 250),
        "gold": lambda p: (p["r"] > 200) & (p["g"] > 140) & (p["r"].cast("int") - p["b"] > 60),
        "dark": lambda p: F.floor(0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"]) < dark,
    }


def profile(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, n): how many pixels of each row a mask has."""
    return runs.groupBy(*by, "y").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))


def islands(spans: DataFrame, by: list[str], a: str, b: str, gap: Column) -> DataFrame:
    """(by, a, b): the union of intervals with ends included, joined across at most ``gap`` places."""
    order = Window.partitionBy(*by).orderBy(a, b)
    upto = F.max(b).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(a) - upto - 1 > gap, F.lit(True)).cast("int")
    marked = spans.withColumn("__new", new).withColumn("__i", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__i").agg(F.min(a).alias(a), F.max(b).alias(b)).drop("__i")


def _near(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def _upper_median(c: Column) -> Column:
    s = F.array_sort(F.collect_list(c))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


@dataclass(frozen=True)
class Layout:
    """How large things are on a plane of ``w`` times ``h`` pixels, as columns; the defaults are those of screens."""

    row_ink: Callable[[], Column] = lambda: F.greatest(F.lit(5), _near(F.col("w") * 0.01))  # pixels that make a row of text
    row_gap: Callable[[], Column] = lambda: F.greatest(F.lit(6), _near(F.col("h") * 0.004))
    block_gap: Callable[[], Column] = lambda: F.greatest(F.lit(18), _near(F.col("w") * 0.03))
    block_width: Callable[[], Column] = lambda: F.greatest(F.lit(10), _near(F.col("w") * 0.02))
    column_reach: Callable[[], Column] = lambda: F.greatest(F.lit(12), _near(F.col("w") * 0.02))
    least_height: int = 8
    heights: tuple[float, float] = (0.55, 2.0)  # of the median
    gold_share: float = 0.015
    pad: int = 4
    least: int = 3  # bands, blocks, members of a column, rows


def _enough(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Only the planes that have ``least`` rows."""
    n = df.withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    return n.where(F.col("__n") >= least).drop("__n")


def bands(ink: DataFrame, sizes: DataFrame, by: list[str], layout: Layout = Layout(), gold: DataFrame | None = None) -> DataFrame:
    """(by, band, a, b, w, h): the rows of text between ``top`` and ``bottom``, from above.

    Rows of pixels with enough ink are joined across small gaps; bands much lower or higher than the (upper) median go,
    and such with more gold than stars below a name have. A plane with too few bands has none. ``sizes``: by, w, h, top
    and bottom.
    """
    p = profile(ink, by).join(sizes, by).where((F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom")) & (F.col("n") >= layout.row_ink()))
    spans = p.select(*by, "w", "h", F.col("y").alias("a"), F.col("y").alias("b"))
    found = _enough(islands(spans, [*by, "w", "h"], "a", "b", layout.row_gap()), by, layout.least)
    tall = F.col("b") - F.col("a") + 1
    med = found.groupBy(*by).agg(_upper_median(tall).alias("med"))
    found = found.join(med, by).where((tall >= F.greatest(F.lit(float(layout.least_height)), F.col("med") * layout.heights[0])) & (tall <= F.col("med") * layout.heights[1])).drop("med")
    found = _enough(found, by, layout.least)
    if gold is not None:
        each = found.withColumn("y", F.explode(F.sequence("a", "b"))).join(profile(gold, by), [*by, "y"], "left")
        share = F.coalesce(F.sum("n"), F.lit(0)) / ((F.col("b") - F.col("a") + 1) * F.col("w"))
        found = _enough(each.groupBy(*by, "w", "h", "a", "b").agg(share.alias("s")).where(F.col("s") <= layout.gold_share).drop("s"), by, layout.least)
    return found.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("a")) - 1).alias("band"), "a", "b", "w", "h")


def _blocks(ink: DataFrame, band: DataFrame, by: list[str], layout: Layout) -> DataFrame:
    """(by, band, a, b, w, h, x0, x1, col, cx, next): the blocks of text that stand in a column, ``next`` the next one's place."""
    inside = band.withColumn("y", F.explode(F.sequence("a", "b"))).join(ink, [*by, "y"])
    keys = [*by, "band", "a", "b", "w", "h"]
    blocks = islands(inside.select(*keys, "x0", "x1"), keys, "x0", "x1", layout.block_gap())
    blocks = _enough(blocks.where(F.col("x1") - F.col("x0") + 1 >= layout.block_width()), by, layout.least)
    reach = layout.column_reach()
    order = Window.partitionBy(*by).orderBy("x0")
    new = F.coalesce(F.col("x0") - F.lag("x0").over(order) > reach, F.lit(True)).cast("int")
    marked = blocks.withColumn("__new", new).withColumn("__c", F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    cols = marked.groupBy(*by, "__c").agg(_upper_median(F.col("x0")).alias("cx"), F.count("*").alias("n")).where(F.col("n") >= layout.least)
    left = Window.partitionBy(*by).orderBy("cx")
    cols = cols.select(*by, "cx", F.lead("cx").over(left).alias("next"), (F.row_number().over(left) - 1).alias("col"))
    near = blocks.join(cols, by).where(F.abs(F.col("x0") - F.col("cx")) <= reach * 1.5)
    best = near.groupBy(*keys, "x0", "x1").agg(F.min(F.struct("col", "cx", "next")).alias("c"))
    return _enough(best.select(*keys, "x0", "x1", "c.*"), by, layout.least)


def text_rows(ink: DataFrame, sizes: DataFrame, by: list[str], layout: Layout = Layout(), gold: DataFrame | None = None) -> DataFrame:
    """(by, band, col, x, y, w, h): boxes of the texts that stand in columns, padded.

    In each band the columns of pixels with ink are joined into blocks; left edges that lie close together, enough of
    them, make a column at their (upper) median; a block belongs to the first column within one and a half times that
    distance, and others are dropped. Planes with too few of anything have no rows.
    """
    own = _blocks(ink, bands(ink, sizes, by, layout, gold), by, layout)
    pad = F.lit(layout.pad)
    x, y = F.greatest(F.lit(0), F.col("x0") - pad), F.greatest(F.lit(0), F.col("a") - pad)
    return own.select(
        *by, "band", "col", x.alias("x"), y.alias("y"), F.least(F.col("w") - x, F.col("x1") - F.col("x0") + 1 + 2 * pad).alias("w"),
        F.least(F.col("h") - y, F.col("b") - F.col("a") + 1 + 2 * pad).alias("h"),
    )


#: A row has at most so many stars, a hole of one column is inside a star, and stars end this share of the
#: width before the next column.
STARS, HOLE, MARGIN = 3, 1, 0.03


def star_counts(ink: DataFrame, gold: DataFrame, sizes: DataFrame, by: list[str], layout: Layout = Layout()) -> DataFrame:
    """(by, band, col, x0, stars, reliable): the stars below each text of ``text_rows``, which begins at ``x0``.

    They are the stretches of gold columns between a band and the next, from the text's column to the next one's. Below
    the last band an area of the (upper) median distance is searched, or of twice the band's height where there is one
    band alone; its count is not reliable, for the screen may end there. An area of no height has none, unreliably.
    """
    band = cut(bands(ink, sizes, by, layout, gold), "bands")
    order = Window.partitionBy(*by).orderBy("band")
    band_next = band.withColumn("below", F.lead("a").over(order))
    gaps = band_next.groupBy(*by).agg(_upper_median(F.col("below") - F.col("b")).alias("gap"))
    far = F.col("b") + F.when(F.coalesce("gap", F.lit(0)) > 0, F.col("gap")).otherwise(2 * (F.col("b") - F.col("a") + 1))
    reach = band_next.join(gaps, by).select(*by, "band", "below", F.coalesce(F.col("below") - 1, F.least(far, F.col("h"))).alias("stop"))
    rows = _blocks(ink, band, by, layout).join(reach, [*by, "band"])
    rows = rows.select(
        *by, "band", "col", "x0", F.greatest(F.lit(0), F.col("cx")).alias("left"), F.least(F.coalesce(F.col("next") - _near(F.col("w") * MARGIN), F.col("w")), F.col("w")).alias("right"),
        (F.col("b") + 1).alias("start"), "stop", (F.col("below").isNotNull() & (F.col("stop") > F.col("b") + 1)).alias("reliable"),
    )
    area = rows.where("stop > start AND right > left").withColumn("y", F.explode(F.sequence("start", F.col("stop") - 1)))
    lit = area.join(gold.select(*by, "y", F.col("x0").alias("g0"), F.col("x1").alias("g1")), [*by, "y"]).where("g1 >= left AND g0 < right")
    keys = [*by, "band", "col", "x0"]
    spans = lit.select(*keys, F.greatest("g0", "left").alias("a"), F.least("g1", F.col("right") - 1).alias("b"))
    found = islands(spans, keys, "a", "b", F.lit(HOLE)).groupBy(*keys).agg(F.least(F.count("*"), F.lit(STARS)).cast("int").alias("stars"))
    out = rows.select(*keys, "reliable").join(found, keys, "left")
    return holding(out.select(*keys, F.coalesce("stars", F.lit(0)).alias("stars"), "reliable"), band)


def parts(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, y, w, h, area) of the 4-connected parts of a mask.

    Runs are joined with those of the next row that share a column of pixels, and runs that hang together, however
    large the part, get one root by rounds of joins; nothing is held a plane at a time.
    """
    key = F.struct(*by, "y", "x0")
    nodes = cut(runs.select(*by, "y", "x0", "x1", F.to_json(key).alias("node")), "runs")
    up, down = nodes.alias("u"), nodes.withColumn("y", F.col("y") - 1).alias("d")
    on = [F.col(f"u.{c}") == F.col(f"d.{c}") for c in [*by, "y"]]
    meet = (F.col("u.x0") <= F.col("d.x1")) & (F.col("d.x0") <= F.col("u.x1"))
    for c in on:
        meet &= c
    roots = connected(up.join(down, meet).select(F.col("u.node").alias("a"), F.col("d.node").alias("b")))
    every = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    box = every.groupBy(*by, "root").agg(F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    out = box.select(*by, "x", "y", (F.col("x1") - F.col("x") + 1).alias("w"), (F.col("y1") - F.col("y") + 1).alias("h"), "area")
    return holding(out, nodes, roots)


def scrolled_between(rows: DataFrame, by: list[str], frame: str = "frame", y: str = "y", values: str = "v", level: float = 5, quiet: int = 100, step: int = 4) -> DataFrame:
    """(by, header, footer): between which rows the screens of a group differ.

    Consecutive screens are compared row by row, by the mean difference of every ``step``-th pixel of the middle three
    fifths. A pair's content runs from its first row over ``level`` to the row before the first stretch of ``quiet`` rows
    that is not; the group's from the least first to the greatest last. Pairs that do not differ say nothing; a group of
    such has no row.
    """
    keys = [*by, "f", "y"]
    pix = rows.dropna(subset=by).select(*by, F.dense_rank().over(Window.partitionBy(*by).orderBy(frame)).alias("f"), F.col(y).alias("y"), F.col(values).alias("p"))
    # Neighbours come from a window, not from a join: pixels are many times what the planner takes them for, and would be broadcast.
    ahead = F.lead(F.struct("f", "p")).over(Window.partitionBy(*by, "y").orderBy("f"))
    both = pix.withColumn("ahead", ahead).where(F.col("ahead.f") == F.col("f") + 1).select(*keys, "p", F.col("ahead.p").alias("q"))
    n = F.least(F.size("p"), F.size("q"))
    at = F.filter(F.sequence(F.floor(n * 0.2).cast("int"), F.ceil(n * 0.8).cast("int") - 1), lambda x: (x - F.floor(n * 0.2)) % step == 0)
    diff = F.aggregate(at, F.lit(0.0), lambda s, x: s + F.abs(F.get("p", x) - F.get("q", x)).cast("double")) / F.size(at)
    signal = both.select(*keys, F.when(diff > level, F.col("y")).alias("on"))
    # Stretches without a difference are what lies between neighbours that differ, or behind the last.
    pair = Window.partitionBy(*by, "f")
    after = F.first("on", True).over(pair.orderBy("y").rowsBetween(1, Window.unboundedFollowing))
    spread = signal.withColumn("end", F.max("y").over(pair)).withColumn("after", after)
    quiet_from = F.when(F.coalesce("after", F.col("end") + 1) - F.col("on") - 1 >= quiet, F.col("on"))
    tall = spread.groupBy(*by, "f").agg(F.min("on").alias("first"), F.max("end").alias("end"), F.min(quiet_from).alias("last")).where("first IS NOT NULL")
    return tall.groupBy(*by).agg(F.min("first").alias("header"), F.max(F.coalesce("last", "end") + 1).alias("footer"))


def without_fixed_foot(rows: DataFrame, found: DataFrame, by: list[str], frame: str = "frame", y: str = "y", values: str = "v", level: float = 4, step: int = 12, least: int = 100) -> DataFrame:
    """``found`` (by, header, footer) with the footer above the rows at the bottom that are the same on all screens.

    Rows are the same if every ``step``-th pixel differs from the first screen's by ``level`` at most. At least ``least``
    rows below the header are left; a group of one screen stays as it is.
    """
    first = Window.partitionBy(*by)
    pix = rows.select(*by, F.col(frame).alias("f"), F.col(y).alias("y"), F.filter(F.col(values), lambda v, x: x % step == 0).alias("v"))
    pix = pix.withColumn("f0", F.min("f").over(first)).withColumn("f1", F.max("f").over(first)).where("f1 > f0")
    # The first screen's row comes from a window, for a join would broadcast pixels.
    base = F.first(F.struct("f", "v")).over(Window.partitionBy(*by, "y").orderBy("f"))
    held = pix.withColumn("base", base)
    differs = F.exists(F.zip_with("v", "base.v", lambda a, b: F.abs(a - b) > level), lambda d: d)
    seen = F.max(F.when((F.col("f") > F.col("f0")) & (F.col("base.f") == F.col("f0")) & differs, F.col("y")))
    got = found.join(held.groupBy(*by).agg(F.max("y").alias("end"), seen.alias("seen")), by, "left")
    stop = F.greatest(F.coalesce("seen", F.lit(-1)), F.least(F.col("header") + least, F.col("end")))
    return got.select(*by, "header", F.when(F.col("end").isNull(), F.col("footer")).otherwise(F.least("footer", stop + 1)).alias("footer"))


def seams(pairs: DataFrame, by: list[str], width: str = "w", a: str = "a", b: str = "b", overlap: int = kernels.OVERLAP, guard: int = kernels.GUARD) -> DataFrame:
    """(by, shift, share, rival, sure): by how many rows plane ``b`` is scrolled on from ``a``, see ``kernels.seam``.

    A pair is one row, its planes lists of pixels; pairs are searched side by side, shifts that cannot win only in part.
    A pair of different or no sizes has nulls. The rival is null where there is none; ``sure`` is what the share and the
    rival's allow.
    """
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by) + ", shift int, share double, rival double, sure boolean"

    def one(x, y, w) -> tuple:
        if x is None or y is None or not w or len(x) != len(y) or len(x) % w or not len(x):
            return None, None, None, None
        found, _ = kernels.seam_search(np.asarray(x).reshape(-1, w), np.asarray(y).reshape(-1, w), overlap, guard)
        if found is None:
            return None, None, None, None
        return found[0], found[1], found[2] if np.isfinite(found[2]) else None, kernels.confident(found)

    def run(frames):
        for t in frames:
            got = pd.DataFrame([one(*r) for r in zip(t[a], t[b], t[width])], columns=["shift", "share", "rival", "sure"])
            got["shift"] = got["shift"].astype("Int32")
            yield pd.concat([t[by].reset_index(drop=True), got], axis=1)

    return pairs.select(*by, a, b, width).mapInPandas(run, schema)
