"""Truth from reads: four classes, what a tab can hold, completeness, and decisions copied to members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.operators import consensus, fuzzy
from lodeframe.storage import cut, holding


def four_way(reads: DataFrame, entries: DataFrame, key: str, strict: str = "strict", full: str = "full", name: str = "name") -> DataFrame:
    """One row per read: ``category`` exact, via_map, ambiguous or unreadable, ``skill`` and ``distance``.

    Both sides carry a strict norm and a full one (letters that look alike made equal). A read with one entry of its
    strict norm is exact; else one of its full norm is found through the map. Everything else that is near an entry is
    ambiguous, at the least distance, and left to a person; a null or empty read is unreadable.
    """
    count = lambda c, n: entries.where(F.col(c) != "").groupBy(F.col(c).alias(f"__{n}")).agg(F.count("*").alias(n), F.min(name).alias(f"{n}_skill"))
    r = reads.select(key, strict, full)
    met = r.join(count(strict, "s"), F.col(strict) == F.col("__s"), "left").join(count(full, "f"), F.col(full) == F.col("__f"), "left")
    one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    via = one("f") & F.coalesce(F.col("s") <= 1, F.lit(True))
    sure = F.when(one("s"), "exact").when(via, "via_map").when(F.col("f") > 1, "ambiguous")
    skill = F.when(one("s"), F.col("s_skill")).when(via, F.col("f_skill"))
    met = met.select(key, full, sure.alias("category"), skill.alias("skill"))
    known = entries.where(F.col(full) != "").select(full).distinct()
    left = met.where(F.col("category").isNull() & (F.col(full) != "")).select(key, full)
    dist = fuzzy.near(left, known, full, full).groupBy(F.col(f"r_{key}").alias(key)).agg(F.min("distance").alias("near"))
    out = met.join(dist, key, "left")
    category = F.coalesce("category", F.when(F.col("near").isNotNull(), "ambiguous"), F.lit("unreadable"))
    return out.select(key, category.alias("category"), "skill", F.when(F.col("category").isNotNull(), 0).otherwise(F.col("near")).alias("distance"))


def strict_accept(reads: DataFrame, entries: DataFrame, key: str, norm: str = "norm", limit: int = 1) -> DataFrame:
    """(key, name): reads that equal an entry, or have exactly one entry within ``limit``, the distance safe for the catalogue."""
    n = lambda c: F.when(c <= 2, 0).otherwise(limit)
    w = Window.partitionBy(f"r_{key}")
    found = fuzzy.near(reads.select(key, norm), entries.select(norm).distinct(), norm, norm, n)
    found = found.withColumn("n", F.count("*").over(w))
    return found.where("distance = 0 OR n = 1").select(F.col(f"r_{key}").alias(key), F.col(f"e_{norm}").alias("name"))


def resolve_names(pasted: DataFrame, entries: DataFrame, norm: str = "norm", name: str = "name") -> DataFrame:
    """``matched``: the entry whose norm equals that of a pasted name, the lowest of several; null where none does."""
    e = entries.where(F.col(norm) != "").groupBy(norm).agg(F.min(name).alias("matched"))
    return pasted.join(e, norm, "left")


def completeness(found: DataFrame, badges: DataFrame, tab: str, kind: str, expected: str) -> DataFrame:
    """(tab, kinds, expected, complete): kinds found against the largest number that a badge gave; null if none was read."""
    n = found.groupBy(tab).agg(F.count_distinct(kind).alias("kinds"))
    e = badges.groupBy(tab).agg(F.max(expected).alias("expected"))
    return n.join(e, tab, "left").withColumn("complete", F.col("kinds") == F.col("expected"))


def write_back(members: DataFrame, rows: DataFrame, row: str, skip: Column) -> DataFrame:
    """``name`` and ``status`` of each member's row; members that are skipped or whose row has no decision are to be checked."""
    out = members.join(rows.select(row, F.col("name").alias("__n"), F.col("status").alias("__s")), row, "left")
    use = ~F.coalesce(skip, F.lit(False))
    return out.withColumn("name", F.when(use, F.col("__n"))).withColumn("status", F.coalesce(F.when(use, F.col("__s")), F.lit("check"))).drop("__n", "__s")


def usable_truth(cards: DataFrame, sets: DataFrame, of: str, need_human: bool) -> DataFrame:
    """Named cards that count: of provisional sets none if a person must have confirmed them, else those not left for a check."""
    j = cards.where(F.col("name").isNotNull()).join(sets.select(of, "provisional"), of)
    fits = F.lit(False) if need_human else ~F.col("decided_by").eqNullSafe(F.lit("check"))
    return j.where(~F.col("provisional") | fits).drop("provisional")


def exact_in_tab(reads: DataFrame, universe: DataFrame, key: str, tab: str, order: str, norm: str, name: str) -> DataFrame:
    """(key, name): of each card's reads in order, the first that equals a name that its tab holds; null if none does."""
    u = universe.groupBy(tab, norm).agg(F.min(name).alias("__name"))
    hit = reads.join(u, [tab, norm], "left")
    return hit.groupBy(key).agg(F.min_by("__name", F.when(F.col("__name").isNotNull(), F.col(order))).alias(name))


def outside_tab(accepted: DataFrame, universe: DataFrame, complete: DataFrame, tab: str, name: str) -> DataFrame:
    """Cards accepted by themselves with a name that their tab, known to be complete, does not hold: certain errors."""
    judged = accepted.where(F.col(name).isNotNull()).join(complete.where("complete").select(tab), tab, "left_semi")
    return judged.join(universe.select(tab, name).distinct(), [tab, name], "left_anti")


def overlap_sample(members: DataFrame, row: str, order: str, k: int) -> DataFrame:
    """Of each row's members in order, ``k`` at equal distances, both ends included; the middle one if k is 1; all if fewer."""
    w = Window.partitionBy(row)
    at = members.withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy(order)) - 1)
    if k == 1:
        spot = F.col("__i") == F.shiftright("__n", 1)
    else:
        spot = F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / (k - 1) + 0.5) == F.col("__i"))
    return at.where((F.col("__n") <= k) | spot).drop("__n", "__i")


def conflicts(df: DataFrame, key: str, value: str, order: list) -> DataFrame:
    """``kept`` and ``clash``: a key's first value in the order, and whether a row gives the key another one."""
    return df.withColumn("kept", F.first(value).over(Window.partitionBy(key).orderBy(*order))).withColumn("clash", F.col("kept") != F.col(value))


def draft_rows(listed: DataFrame, reads: DataFrame, overrides: DataFrame, by: list[str], least: float = 0.4) -> DataFrame:
    """(by, index, gold, name, status, reads, votes, exact_votes, share, tied) for each row of a stitched list.

    ``listed``: by, grid, side, ids and gold_count, total, as ``stitch.merged`` gives; ``reads``: id, name (null where a
    read gave none) and exact; ``overrides``: id, name, what a person has decided, one a card. A row of which more than half the
    cards are gold is excluded. Else the first override of its cards in their order decides; else the name with the most
    votes, if it stands alone, was read exactly at least once and has that share of the reads; every other row is to be
    checked, with the name that leads. Rows are numbered from the top. Cards without reads count for nothing.
    """
    place = Window.partitionBy(*by).orderBy("grid", "side")
    key = F.struct(*by, "grid", "side")
    rows = listed.withColumn("index", (F.row_number().over(place) - 1).cast("int")).withColumn("gold", F.col("gold_count") * 2 > F.col("total"))
    # Read three times below; without the cut the whole list would be made for each.
    rows = cut(rows.withColumn("row", F.to_json(key)).select(*by, "index", "gold", "row", "ids"), "rows")
    cards = rows.select("row", "gold", F.posexplode("ids").alias("at", "id"))
    told = cards.join(overrides.select("id", F.col("name").alias("own")), "id").groupBy("row").agg(F.min_by("own", "at").alias("own"))
    tally = consensus.vote_tally(cards.where("NOT gold").select("row", "id").join(reads, "id"), "row", "name", "exact")
    met = rows.join(told, "row", "left").join(tally, "row", "left")
    sure = F.col("top").isNotNull() & ~F.col("tied") & (F.col("exact_votes") > 0) & (F.col("share") >= least)
    status = F.when(F.col("gold"), "excluded").when(F.col("own").isNotNull(), "override").when(F.coalesce(sure, F.lit(False)), "voted").otherwise("check")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = met.select(
        *by, "index", "gold", F.when(~F.col("gold"), F.coalesce("own", "top")).alias("name"), status.alias("status"), none("reads"), none("votes"),
        none("exact_votes"), F.when(~F.col("gold"), F.col("share")).alias("share"), F.coalesce("tied", F.lit(False)).alias("tied"),
    )
    return holding(out, rows)
