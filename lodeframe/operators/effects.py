"""What passes over a screen: blocks that one sample shows otherwise than its neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How far the content of a sample must have moved from the one that is judged and from other witnesses, how
# many witnesses there are at most, and from which difference of mean levels on a block is another.
MOVED, APART, WITNESSES, DIFFERENT = 120, 140, 3, 5


def witnesses(samples: DataFrame, picks: DataFrame, by: list[str], reach: int = 24, moved: float = MOVED, apart: float = APART, most: int = WITNESSES) -> DataFrame:
    """(by, pick, other, rank): the samples that bear witness for each picked one, the nearest first.

    ``samples``: by, n (their number in order of time), pos (the place of their content, null where it is not known);
    ``picks``: by, n. Candidates are up to ``reach`` samples after the pick, then as many before it, in order of distance; one
    is taken if its content has moved by ``moved`` from the pick's, so that what stays in one place of the screen lies
    elsewhere, and by ``apart`` from every one taken before.
    """
    known = samples.dropna(subset=[*by, "n"])
    each = known.withColumn("__taken", _taken(by, [], reach, moved, apart, most)).where("pos IS NOT NULL")
    each = each.join(picks.select(*by, "n").distinct(), [*by, "n"], "left_semi")
    each = each.select(*by, F.col("n").alias("pick"), F.posexplode("__taken").alias("rank", "c"))
    return each.select(*by, "pick", F.col("c.other").alias("other"), "rank")


def _taken(by: list[str], more: list[str], reach: int, moved: float, apart: float, most: int) -> Column:
    """Of each sample (by, n, pos) its witnesses (other, at and ``more`` columns), found by a window instead of a join."""
    one = F.when(F.col("pos").isNotNull(), F.struct(F.col("n").alias("other"), F.col("pos").alias("at"), *more))
    around = F.collect_list(one).over(Window.partitionBy(*by).orderBy("n").rangeBetween(-reach, reach))
    off = lambda c: F.abs(c["at"] - F.col("pos")) >= moved
    later = F.filter(around, lambda c: (c["other"] > F.col("n")) & off(c))
    before = F.reverse(F.filter(around, lambda c: (c["other"] < F.col("n")) & off(c)))
    fits = lambda acc, c: (F.size(acc) < most) & F.forall(acc, lambda x: F.abs(x["at"] - c["at"]) >= apart)
    return F.aggregate(F.concat(later, before), F.slice(around, 1, 0), lambda acc, c: F.when(fits(acc, c), F.concat(acc, F.array(c))).otherwise(acc))


def grids_voted_out(
    samples: DataFrame, by: list[str], cols: int, reach: int = 24, moved: float = MOVED, apart: float = APART, most: int = WITNESSES, different: float = DIFFERENT
) -> DataFrame:
    """``voted_out`` of every sample by its ``witnesses``, where what a sample shows is a grid of blocks.

    ``samples``: by, n, pos, top (the row of its first blocks) and levels, an array of ``cols`` blocks a row. Levels come
    to a sample by a window over those around it and are looked up by their place, so that blocks are neither shuffled
    nor sorted.
    """
    known = samples.dropna(subset=[*by, "n"]).select(*by, "n", "pos", "top", "levels")
    seen = known.withColumn("__taken", _taken(by, ["top", "levels"], reach, moved, apart, most)).where("pos IS NOT NULL AND size(__taken) >= 2")
    seen = seen.select(*by, F.col("n").alias("pick"), "top", "levels", *(F.get("__taken", F.lit(i)).alias(f"__w{i}") for i in range(most)))
    kept = [f"__w{i}" for i in range(most)]
    each = seen.select(*by, "pick", "top", *kept, F.posexplode("levels").alias("__at", "level")).where("level IS NOT NULL")
    each = each.withColumn("col", F.col("__at") % cols).withColumn("row", F.col("top") + F.expr(f"__at div {cols}").cast("int"))
    shown = [F.get(f"{w}.levels", ((F.col("row") - F.col(f"{w}.top")) * cols + F.col("col")).cast("int")).alias(f"__v{i}") for i, w in enumerate(kept)]
    each = each.select(*by, "pick", "row", "col", "level", *(F.col(f"{w}.other").alias(f"__o{i}") for i, w in enumerate(kept)), *shown)
    vs = [F.col(f"__v{i}") for i in range(most)]
    k = sum((v.isNotNull().cast("int") for v in vs), F.lit(0))
    spread, off = F.greatest(*vs) - F.least(*vs), F.least(*(F.abs(v - F.col("level")) for v in vs))
    source = F.coalesce(*(F.when(v.isNotNull(), F.col(f"__o{i}")) for i, v in enumerate(vs)))
    return each.where((k >= 2) & (spread <= different) & (off > different)).select(*by, "pick", "row", "col", source.alias("source"))


def voted_out(blocks: DataFrame, seen: DataFrame, by: list[str], different: float = DIFFERENT) -> DataFrame:
    """(by, pick, row, col, source): the blocks of picked samples that are an effect, and whose pixels to take instead.

    ``blocks``: by, n, row, col (places in the content, not on the screen) and level; ``seen``: the ``witnesses``. A block
    is an effect if two witnesses or more show its place, agree among themselves within ``different``, and all differ
    from the pick by more. The first witness that shows it is the source. Blocks without a level count for nothing.
    """
    b = blocks.where("level IS NOT NULL")
    # Blocks are many to a sample, which the planner does not know; unless told, it broadcasts them.
    own = seen.select(*by, "pick").distinct().join(b.withColumnRenamed("n", "pick").hint("merge"), [*by, "pick"])
    theirs = seen.join(b.select(*by, F.col("n").alias("other"), "row", "col", F.col("level").alias("v")).hint("merge"), [*by, "other"])
    both = own.join(theirs.hint("merge"), [*by, "pick", "row", "col"])
    vote = both.groupBy(*by, "pick", "row", "col").agg(
        F.count("*").alias("k"), (F.max("v") - F.min("v")).alias("spread"), F.min(F.abs(F.col("v") - F.col("level"))).alias("off"), F.min_by("other", "rank").alias("source"),
    )
    return vote.where((F.col("k") >= 2) & (F.col("spread") <= different) & (F.col("off") > different)).select(*by, "pick", "row", "col", "source")
