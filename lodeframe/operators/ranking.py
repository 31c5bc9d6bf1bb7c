"""Display orders, row filters and counts of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.functions.stars import ok
from lodeframe.operators import fuzzy
from lodeframe.storage import cut, holding


def places(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``name``: each row's place, from 0, in one order of the whole table; an order with ties leaves these as they come.

    The table is sorted by ranges and written once; what a task counted before is added up over the tasks, so that no
    task meets all rows.
    """
    at = cut(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "places")
    part = F.shiftrightunsigned("__m", 33)
    sizes = at.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row per partition of the sort.
    starts = F.broadcast(sizes.select("__p", before.alias("__before")))
    out = at.withColumn("__p", part).join(starts, "__p")
    return holding(out.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__before"), at)


def near_candidates(reads: DataFrame, entries: DataFrame, key: str, norm: str = "norm", name: str = "name", k: int = 8) -> DataFrame:
    """(key, place, name, distance): each read's nearest entries, the longer and then the lower name first, at most ``k``."""
    n, by = F.col(f"e_{name}"), f"r_{key}"
    w = Window.partitionBy(by).orderBy("distance", F.desc(F.length(n)), n)
    top = fuzzy.near(reads, entries, norm, norm).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return top.select(F.col(by).alias(key), "place", n.alias(name), "distance")


def holders_list(family: DataFrame, parents: DataFrame, pid: str, skill: str, own: str = "own", grandparents: tuple[str, ...] = ("g1", "g2")) -> DataFrame:
    """(skill, place, pid, own, only_gp): each skill's holders, those with most skills of their own first, then the newest.

    ``parents`` has pid, day and no. A record holds a skill by itself or through a linked one (``only_gp``).
    """
    mine = ok(F.col(own), 1)
    linked = F.lit(False)
    for g in grandparents:
        linked |= ok(F.col(g), 1)
    counts = family.groupBy(pid).agg(F.count_if(mine).alias("n"))
    held = family.where(mine | linked).select(pid, skill, F.coalesce(own, F.lit(0)).alias("own"), (~mine).alias("only_gp"))
    w = Window.partitionBy(skill).orderBy(F.desc("n"), F.desc("day"), F.desc("no"))
    return held.join(counts, pid).join(parents.select(pid, "day", "no"), pid).withColumn("place", F.row_number().over(w)).drop("n", "day", "no")


def result_order(results: DataFrame, by: str, state: Column, game: str, name: Column) -> DataFrame:
    """``place`` within ``by``: by state; within a state decided rows (with a place in the game's order) first; then by name."""
    w = Window.partitionBy(by).orderBy(state, F.col(game).isNull(), F.col(game), name)
    return results.withColumn("place", F.row_number().over(w))


def display_order(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """``pos`` of each row in the list of keys (key, pos); ``missing`` where the list does not have it, which is an error."""
    return rows.join(listed.select(key, "pos"), key, "left").withColumn("missing", F.col("pos").isNull())


def visible_rows(rows: DataFrame, name: str, text: str = "", chosen: dict[str, list[str]] | None = None, age: str | None = None, old: Column | None = None) -> DataFrame:
    """Rows whose tags (arrays, or one value) meet every axis with a choice, whose name contains the text, and which are new or old.

    ``age`` is "new", "old" or None; ``old`` tells whether a row came with an earlier list.
    """
    out = rows
    for col, values in (chosen or {}).items():
        if values:
            several = out.schema[col].dataType.typeName() == "array"
            out = out.where(F.arrays_overlap(col, F.array(*map(F.lit, values))) if several else F.col(col).isin(values))
    if age and old is not None:
        out = out.where(old if age == "old" else ~old)
    text = text.strip()
    return out.where(F.contains(F.col(name), F.lit(text))) if text else out


def enabled_sums(cells: DataFrame, candidates: DataFrame, skill: str, candidate: str, value: str) -> DataFrame:
    """(skill, total): the sum over enabled candidates; 0 where none of them has the skill. ``candidates``: candidate, enabled."""
    c = cells.join(candidates.select(candidate, "enabled"), candidate, "left")
    return c.groupBy(skill).agg(F.coalesce(F.sum(F.when(F.col("enabled"), F.col(value))), F.lit(0)).alias("total"))


def row_filter(sums: DataFrame, show: str) -> DataFrame:
    """The rows that are wanted: "zero", "nonzero" (over zero) or all."""
    return sums.where({"zero": "total = 0", "nonzero": "total > 0"}.get(show, "true"))


def set_counts(parents: DataFrame, sets: DataFrame, pid: str, of: str, key: str) -> DataFrame:
    """(key, n): how many records are in each set; a record counts once a set, and sets without records count 0."""
    inside = parents.select(F.explode(F.array_distinct(of)).alias(key)).groupBy(key).agg(F.count("*").alias("n"))
    return sets.select(key).join(inside, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def kind_counts(items: DataFrame, by: str, kind: str, plain: list[str]) -> DataFrame:
    """(by, kind, n): items of each kind; unknown kinds and those of ``plain`` are one, "plain"."""
    k = F.when(F.col(kind).isNull() | F.col(kind).isin(plain), "plain").otherwise(F.col(kind))
    return items.groupBy(by, k.alias("kind")).agg(F.count("*").alias("n"))


def distinct_kinds(items: DataFrame, by: str, norm: Column) -> DataFrame:
    """(by, kinds, items): different keys, those that could not be read (null or empty) left out of the kinds only."""
    return items.groupBy(by).agg(F.count_distinct(F.when(norm != "", norm)).alias("kinds"), F.count("*").alias("items"))


def first_seen(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """(by, names): each key's different names in the order in which they come first; null and empty ones left out."""
    first = df.where(F.col(name) != "").groupBy(by, name).agg(F.min(F.struct(*order)).alias("o"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", name))), lambda x: x[name]).alias("names"))
