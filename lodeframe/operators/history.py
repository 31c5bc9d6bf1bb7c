"""An append-only log of changes: the table as it was, what a change did, and taking a change back.

A log row (scope, version, key, values, gone) says what a key of a scope holds from that version on, or that it is gone.
Versions of a scope grow; a key is written once in a version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changes(before: DataFrame, after: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, values, gone): what must be logged so that the table ``before`` becomes ``after``; equal rows need nothing."""
    row = F.struct(*values)
    both = before.select(*by, row.alias("b")).join(after.select(*by, row.alias("a")), by, "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*by, "a.*", F.col("a").isNull().alias("gone"))


def logged(log: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """``log`` with the changes ``new`` (scope, key, values, gone) as the next version of each scope."""
    last = log.groupBy(scope).agg(F.max("version").alias("version"))
    numbered = new.join(last, scope, "left").withColumn("version", F.coalesce("version", F.lit(0)) + 1)
    return log.unionByName(numbered.select(*log.columns))


def as_of(log: DataFrame, by: list[str], values: list[str], until: Column | None = None) -> DataFrame:
    """(by, version, values): what every key holds after the versions for which ``until`` holds (all, if not given)."""
    seen = log if until is None else log.where(until)
    last = seen.groupBy(*by).agg(F.max_by(F.struct("version", *values, "gone"), "version").alias("r"))
    return last.where("NOT r.gone").select(*by, "r.version", *(f"r.{v}" for v in values))


def probe(state: DataFrame, scope: str, key: str, values: list[str]) -> DataFrame:
    """(scope, n, digest): a mark of what a scope holds, whatever the order of its rows."""
    each = F.xxhash64(key, *values)
    return state.groupBy(scope).agg(F.count("*").alias("n"), F.bit_xor(each).alias("digest"))


def taken_back(log: DataFrame, targets: DataFrame | Column, scope: str, key: str, values: list[str]) -> DataFrame:
    """(scope, version, key, values, gone): log rows that undo the version that ``targets`` (scope, version) names.

    A version is taken back as a whole, and only if every key that it wrote still holds what it wrote then: what
    somebody changed since is not overwritten. Its keys get what they held before, or go if they held nothing; the rows
    carry the next version, so an undo can be undone. Scopes that may not have no rows, unknown versions neither.

    ``targets`` may be a column of the log's rows instead, equal in all rows of a scope; then the log is read once and joined
    with nothing. Each value of a key is found by itself, so that values of fixed width need no sort of the log's rows by key.
    """
    if isinstance(targets, Column):
        rows = log.withColumn("__t", targets)
    else:
        rows = log.join(targets.select(scope, F.col("version").alias("__t")), scope)
    version, t, fields = F.col("version"), F.col("__t"), [*values, "gone"]
    held = lambda name, at: [F.max_by(f, at).alias(f"__{name}_{f}") for f in fields]
    per = rows.groupBy(scope, key, "__t").agg(
        *held("then", F.when(version <= t, version)), *held("last", version), *held("was", F.when(version < t, version)),
        F.max((version == t).cast("int")).alias("__wrote"), F.max("version").alias("__top"),
    )
    equal = reduce(Column.__and__, (F.col(f"__then_{f}").eqNullSafe(F.col(f"__last_{f}")) for f in fields))
    same = F.when(F.col("__then_gone") & F.col("__last_gone"), True).otherwise(equal)
    whole = Window.partitionBy(scope)
    wrote = F.col("__wrote") == 1
    fine = per.select(
        scope, (F.max("__top").over(whole) + 1).alias("version"), key, *(F.when(~F.col("__was_gone"), F.col(f"__was_{v}")).alias(v) for v in values),
        F.coalesce("__was_gone", F.lit(True)).alias("gone"), wrote.alias("__wrote"), F.bool_and(F.when(wrote, same)).over(whole).alias("__fine"),
    )
    return fine.where("__wrote AND __fine").drop("__wrote", "__fine")
