"""Faceted search over arrays of tags, and predicates with three answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that count as another one.
MERGED = {"temptation_time": "debuff", "lane_change": "course_sense"}


def axis(tags: Column, chosen: list[str], empty_passes: bool = True, exclusive: bool = False, merged: dict[str, str] | None = None) -> Column:
    """Whether the tags of one axis fit a choice: any of them, or all of them for an exclusive axis.

    Nothing chosen lets everything pass. Without tags a row passes, except on axes where that means none of the values.
    """
    if not chosen:
        return F.lit(True)
    table = merged if merged is not None else MERGED
    plain = tags
    if table:
        names = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
        plain = F.transform(tags, lambda t: F.coalesce(F.try_element_at(names, t), t))
    want = F.array(*(F.lit(table.get(c, c)) for c in chosen))
    hit = F.forall(plain, lambda t: F.array_contains(want, t)) if exclusive else F.arrays_overlap(plain, want)
    return F.when(F.size(tags) > 0, F.coalesce(hit, F.lit(False))).otherwise(F.lit(empty_passes))


def search(df: DataFrame, choice: dict[str, list[str]], empty_fails: set[str] = frozenset(), exclusive: set[str] = frozenset()) -> DataFrame:
    """Rows that fit the choice on every axis."""
    return df.where(reduce(lambda a, b: a & b, (axis(F.col(a), c, a not in empty_fails, a in exclusive) for a, c in choice.items()), F.lit(True)))


def population(master: DataFrame, extended: DataFrame, passive: Column, excluded: DataFrame, listed: DataFrame, key: str, with_passive: bool = False) -> DataFrame:
    """What a search may find: the master without passives (unless asked for) and exclusions, and listed extended rows."""
    base = master if with_passive else master.where(~passive)
    return base.join(excluded.select(key), key, "left_anti").unionByName(extended.join(listed.select(key), key, "left_semi"))


def interval(low: Column, high: Column, at_low: Column, at_high: Column) -> Column:
    """must, may or no: the known range lies within low..high, overlaps it, or does not. Bounds are inclusive, null open."""
    lo, hi = F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(2**31 - 1))
    return F.when((at_low >= lo) & (at_high <= hi), "must").when((at_high < lo) | (at_low > hi), "no").otherwise("may")


def all_of(*answers: Column) -> Column:
    """ok, ng or unknown of several such: one ng decides, else one unknown (or null) does."""
    some = lambda v: reduce(lambda a, b: a | b, (F.coalesce(a, F.lit("unknown")) == v for a in answers))
    return F.when(some("ng"), "ng").when(some("unknown"), "unknown").otherwise("ok")


def venue_ok(venue: Column, allowed: list[str]) -> Column:
    """A venue that is not known rejects nothing."""
    return venue.isNull() | venue.isin(allowed)


def course_applies(tracks: Column, venue: Column, surface: Column, distance: Column) -> Column:
    """Whether a condition's tracks list a course: the venue, and where it names courses, the surface and distance.

    Null while anything that is needed is unknown. ``tracks``: array<struct<venue, courses: array<struct<surface, distances>>>>.
    """
    named = F.filter(tracks, lambda t: t["venue"] == venue)
    free = F.exists(named, lambda t: F.size(F.coalesce(t["courses"], F.array())) == 0)
    fits = F.exists(named, lambda t: F.exists(t["courses"], lambda c: (c["surface"] == surface) & F.array_contains(c["distances"], distance)))
    return (
        F.when(venue.isNull(), F.lit(None)).when(F.size(named) == 0, False).when(free, True)
        .when(surface.isNull() | distance.isNull(), F.lit(None)).otherwise(fits).cast("boolean")
    )


def race_blocks(rejects: Column, locked: Column, matches: Column) -> Column:
    return rejects | (locked & ~matches)
