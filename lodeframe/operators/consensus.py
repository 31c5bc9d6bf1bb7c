"""Merging repeated observations of one thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def smallest_mode(obs: DataFrame, key: str, value: str, reliable: str) -> DataFrame:
    """(key, value, votes): the most frequent value, the smallest of equals; reliable observations alone where any exist.

    Nulls and zeros are no observations.
    """
    n = obs.where(F.col(value) > 0).groupBy(key, value).agg(F.count("*").alias("n"), F.count_if(F.col(reliable)).alias("good"))
    any_good = F.sum("good").over(Window.partitionBy(key)) > 0
    n = n.withColumn("votes", F.when(any_good, F.col("good")).otherwise(F.col("n"))).where("votes > 0")
    best = F.max(F.struct("votes", (-F.col(value)).alias("low"))).alias("b")
    return n.groupBy(key).agg(best).select(key, (-F.col("b.low")).alias(value), F.col("b.votes").alias("votes"))


def vote_tally(reads: DataFrame, row: str, candidate: str, exact: str) -> DataFrame:
    """One line per row: top candidate, votes, exact votes, reads, share, tied.

    Votes count first, then exact votes; a null candidate is an abstention and counts among the reads.
    """
    n = reads.groupBy(row, candidate).agg(F.count("*").alias("votes"), F.count_if(F.col(exact)).alias("exact_votes"))
    whole = Window.partitionBy(row)
    order = Window.partitionBy(row).orderBy(F.col(candidate).isNull(), F.desc("votes"), F.desc("exact_votes"), candidate)
    n = n.withColumn("reads", F.sum("votes").over(whole)).withColumn("k", F.row_number().over(order))
    n = n.withColumn("next_votes", F.lead("votes").over(order)).withColumn("next_exact", F.lead("exact_votes").over(order))
    n = n.withColumn("next_id", F.lead(candidate).over(order)).where("k = 1")
    tied = F.col("next_id").isNotNull() & (F.col("votes") == F.col("next_votes")) & (F.col("exact_votes") == F.col("next_exact"))
    none = F.col(candidate).isNull()
    return n.select(
        row, F.col(candidate).alias("top"), F.when(none, 0).otherwise(F.col("votes")).alias("votes"),
        F.when(none, 0).otherwise(F.col("exact_votes")).alias("exact_votes"), "reads",
        F.when(none, 0.0).otherwise(F.col("votes") / F.col("reads")).alias("share"), (tied & ~none).alias("tied"),
    )


def decided(tally: DataFrame, least: float = 0.4) -> DataFrame:
    """Rows whose top is alone, was read exactly at least once, and has at least that share of the reads."""
    return tally.where(F.col("top").isNotNull() & ~F.col("tied") & (F.col("exact_votes") > 0) & (F.col("share") >= least))


def combine_variants(reads: DataFrame, item: str) -> DataFrame:
    """One line per item from its variants (kind, matched, distance, confidence, auto).

    Variants that hit more than one different name for certain make it a review; else the best variant: by kind (exact,
    review, none; an accepted review is half a rank better), distance (null last), confidence.
    """
    rank = F.when(F.col("kind") == "exact", 0.0).when(F.col("kind") == "review", 1.0).otherwise(2.0) - F.when(F.col("auto"), 0.5).otherwise(0.0)
    sure = F.size(F.collect_set(F.when((F.col("kind") == "exact") | F.col("auto"), F.col("matched"))))
    best = F.min_by(F.struct("kind", "matched", "distance"), F.struct(rank, F.coalesce("distance", F.lit(99)), -F.col("confidence"), "matched"))
    got = reads.groupBy(item).agg(sure.alias("n_sure"), best.alias("b"))
    clash = F.col("n_sure") > 1
    return got.select(
        item, F.when(clash, "review").otherwise(F.col("b.kind")).alias("kind"), F.when(~clash, F.col("b.matched")).alias("matched"),
        F.when(~clash, F.col("b.distance")).alias("distance"), F.col("n_sure").cast("int").alias("n_sure"),
    )


def best_of_images(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The best row of each key over all images."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")


def drop_settled(undecided: DataFrame, decided_rows: DataFrame, key: str, candidates: str, name: str) -> DataFrame:
    """Undecided rows of which some candidate is not decided elsewhere; rows without candidates stay."""
    each = undecided.select(key, F.explode(candidates).alias("__c"))
    open_ = each.join(decided_rows.select(F.col(name).alias("__d")).distinct(), F.col("__c") == F.col("__d"), "left_anti").select(key).distinct()
    none = undecided.where((F.size(candidates) <= 0) | F.col(candidates).isNull())
    return undecided.join(open_, key, "left_semi").unionByName(none)


def histogram10(df: DataFrame, share: str, *by: str) -> DataFrame:
    """Counts in ten equal bins of 0 to 1; 1 falls in the last bin, null in the first."""
    b = F.least(F.lit(9), F.floor(F.coalesce(F.col(share), F.lit(0.0)) * 10 / 1.0001)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def sweep(df: DataFrame, thresholds: list[float], share: str, right: str) -> DataFrame:
    """For each threshold how many rows are decided, decided wrongly, and left to check; one pass over the rows."""
    at = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold")
    dec = F.col(share) >= F.col("threshold")
    return df.select(share, right, at).groupBy("threshold").agg(
        F.count_if(dec).alias("decided"), F.count_if(dec & ~F.col(right)).alias("wrong"), F.count_if(~F.coalesce(dec, F.lit(False))).alias("to_check")
    )


def accuracy(df: DataFrame, by: str, auto: str, correct: str) -> DataFrame:
    """Counts by category; a null truth is neither right nor wrong."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(F.col(auto) & F.col(correct)).alias("auto_right"),
        F.count_if(F.col(auto) & ~F.col(correct)).alias("auto_wrong"), F.count_if(F.col(correct).isNull()).alias("no_truth"),
    )


def consensus_box(boxes: DataFrame, by: str, key: str, tolerance: int = 2, share: float = 0.6) -> DataFrame:
    """(by, x, y, w, h, n, total, ok): the upper medians of the largest set of boxes within ``tolerance`` of one of them.

    The first box in order of ``key`` wins among equals; ``ok`` if the set holds at least ``share`` of all. Coordinates are
    whole numbers. Equal boxes are counted first and compared as one, within ``by`` and within one or two steps of a
    coarse grid on x; medians come from the counts at each offset from a box, so no list of boxes is gathered.
    """
    fields = ("x", "y", "w", "h")
    a = boxes.groupBy(by, *fields).agg(F.min(key).alias("k"), F.count("*").alias("c"))
    grid = F.floor(F.col("x") / (tolerance + 1))
    left = a.withColumn("g", grid)
    right = a.withColumn("g", F.explode(F.array(grid - 1, grid, grid + 1)))
    near = [F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) <= tolerance for c in fields]
    on = (F.col(f"l.{by}") == F.col(f"r.{by}")) & (F.col("l.g") == F.col("r.g"))
    for n in near:
        on &= n
    steps = range(-tolerance, tolerance + 1)
    at = lambda c, o: F.sum(F.when(F.col(f"r.{c}") <= F.col(f"l.{c}") + o, F.col("r.c")).otherwise(0)).alias(f"{c}_{o + tolerance}")
    sets = left.alias("l").join(right.alias("r"), on).groupBy(F.col(f"l.{by}").alias(by), F.col("l.k").alias("k"), *(F.col(f"l.{c}").alias(c) for c in fields)).agg(
        F.sum("r.c").alias("n"), *(at(c, o) for c in fields for o in steps)
    )
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "k"))
    sets = sets.withColumn("__k", best).where("__k = 1")
    total = boxes.groupBy(by).agg(F.count("*").alias("total"))
    half = F.floor(F.col("n") / 2)
    mid = [F.coalesce(*(F.when(F.col(f"{c}_{o + tolerance}") > half, F.col(c) + o) for o in steps)).cast(boxes.schema[c].dataType).alias(c) for c in fields]
    return sets.join(total, by).select(by, *mid, "n", "total", (F.col("n") >= share * F.col("total")).alias("ok"))


def vote_value(values: Column) -> Column:
    return F.mode(values, True)
