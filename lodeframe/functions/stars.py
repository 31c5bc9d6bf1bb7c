"""Star values: 1 to 3 known, -1 present but unknown, null absent or unreadable. The two kinds of missing stay apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ok(star: Column, threshold: int) -> Column:
    """Whether a star satisfies a threshold: null never, unknown only the threshold 1."""
    return F.coalesce(F.when(star < 0, F.lit(threshold == 1)).otherwise(star >= threshold), F.lit(False))


def counted(star: Column, threshold: int) -> Column:
    """A star's share of a family sum: itself from the threshold on; unknown counts 1, and only at threshold 1."""
    known = F.when(star >= threshold, star).otherwise(0)
    return F.coalesce(F.when(star < 0, F.lit(int(threshold == 1))).otherwise(known), F.lit(0)).cast("int")


def family_sum(threshold: int, *members: Column) -> Column:
    return reduce(lambda a, b: a + b, (counted(m, threshold) for m in members))


def triple(threshold: int, *members: Column) -> Column:
    """Like ``family_sum``, but unknown stars count nothing."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.when(m >= threshold, m), F.lit(0)).cast("int") for m in members))


def family_has(threshold: int, own: Column, *grandparents: Column, grandparents_only: bool = False) -> Column:
    """Whether the threshold is met by oneself or a grandparent; or by a grandparent alone."""
    far = reduce(lambda a, b: a | b, (ok(g, threshold) for g in grandparents))
    return far if grandparents_only else ok(own, threshold) | far


def bucket5(total: Column) -> Column:
    """Five shades: 0, 1-2, 3-4, 5-6, 7-8, from 9 on 5."""
    return F.least(F.lit(5), F.ceil(total / 2)).cast("int")


def merge_known(old: Column, new: Column) -> Column:
    """Two maps of stars as one: a new value replaces the old one unless it is unknown or missing."""
    return F.map_zip_with(old, new, lambda k, a, b: F.when(b.isNull() | ((b < 0) & a.isNotNull()), a).otherwise(b))


def merge_scalar(old: Column, new: Column) -> Column:
    return F.when(new.isNull() | ((new < 0) & old.isNotNull()), old).otherwise(new)


def differs(a: Column, b: Column) -> Column:
    """Both known and unequal."""
    return F.coalesce((a > 0) & (b > 0) & (a != b), F.lit(False))


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted list: the upper of the two middle ones. The other median is ``F.median``."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.get(s, F.floor(F.size(s) / 2).cast("int")))


def nearest_rank(values: Column, share: float) -> Column:
    """The element at round(share * (n - 1)) of the sorted list."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.get(s, F.round(F.lit(share) * (F.size(s) - 1)).cast("int")))


def first_phase(names: Column, phases: dict[str, int], default: int = 3) -> Column:
    """The smallest phase of the mapped names, else the default."""
    table = F.create_map(*(F.lit(x) for kv in phases.items() for x in kv))
    return F.coalesce(F.array_min(F.transform(names, lambda n: F.try_element_at(table, n))), F.lit(default))


def percent_cost(base: Column, *percents: Column) -> Column:
    """base * (100 - the sum of the percentages) / 100, rounded down in integers, so that no fraction is ever held."""
    off = reduce(lambda a, b: a + b, percents)
    return _int_div(base * (100 - off), 100)


def _int_div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


def distance_class(metres: Column) -> Column:
    # The longest race of each class.
    return F.when(metres <= 1400, "short").when(metres <= 1800, "mile").when(metres <= 2400, "middle").when(metres.isNotNull(), "long")


def days_since(then: Column, now: Column) -> Column:
    """Whole days between two timestamps, rounded down."""
    return F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(then.cast("timestamp"))) / 86_400_000).cast("long")


def zone_day(at: Column, hours: int = 9) -> Column:
    """The number of the calendar day in a zone ``hours`` ahead of UTC."""
    return F.floor((F.unix_millis(at.cast("timestamp")) + hours * 3_600_000) / 86_400_000).cast("long")


def fresh(at: Column, now: Column, days: int = 30, hours: int = 9) -> Column:
    """At most ``days`` calendar days old there; what lies ahead is fresh."""
    return zone_day(now, hours) - zone_day(at, hours) <= days


def iso_local(at: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd'T'HH:mm:ss")


def race_label(day: Column, label: Column) -> Column:
    """M/D of an ISO day, without leading zeros; the label, or nothing, where there is no such day."""
    iso = r"^\d{4}-(\d{2})-(\d{2})$"
    part = lambda i: F.regexp_extract(day, iso, i).cast("int").cast("string")
    return F.when(day.rlike(iso), F.concat(part(1), F.lit("/"), part(2))).otherwise(F.coalesce(label, F.lit("")))
