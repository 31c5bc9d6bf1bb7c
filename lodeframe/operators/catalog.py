"""Versioned catalogs: joins into a snapshot, integrity rules, differences between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VERSION = r"^\d{4}-\d{2}-\d{2}[a-z]$"


def snapshot(master: DataFrame, extended: DataFrame, names: DataFrame, key: str, measures: DataFrame | None = None) -> DataFrame:
    """Master and then extended rows, with the joined name (null where there is none) and what may be selected.

    ``selectable`` is true unless it says otherwise; measures count only where they are numbers.
    """
    both = master.withColumn("__part", F.lit(0)).unionByName(extended.withColumn("__part", F.lit(1)), allowMissingColumns=True)
    out = both.join(names, key, "left")
    if "selectable" in out.columns:
        out = out.withColumn("selectable", F.coalesce("selectable", F.lit(True)))
    if measures is not None:
        out = out.join(measures.where(F.try_to_number(F.col("value").cast("string"), F.lit("99999999D999")).isNotNull()), key, "left")
    return out


def last_wins(df: DataFrame, key: str, pos: str) -> DataFrame:
    """One row per key: the last."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(pos)))).where("__k = 1").drop("__k")


def unknown_keys(df: DataFrame, json: str, key: str, allowed: list[str], needed: list[str] = ()) -> DataFrame:
    """(key, problem, name) for each key of a JSON object outside the allow-list and each needed one it lacks."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    extra = F.array_except(keys, F.array(*map(F.lit, allowed)))
    lack = F.array_except(F.array(*map(F.lit, needed)) if needed else F.array().cast("array<string>"), keys)
    listed = lambda a, kind: F.transform(a, lambda x: F.struct(F.lit(kind).alias("problem"), x.alias("name")))
    return df.select(key, F.explode(F.concat(listed(extra, "unknown"), listed(lack, "missing"))).alias("p")).select(key, "p.*")


def repeated(df: DataFrame, *by: str) -> DataFrame:
    """Values that occur more than once, with their number."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def dangling(df: DataFrame, col: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference leads nowhere; a null reference is none."""
    return df.where(F.col(col).isNotNull()).join(target.select(F.col(key).alias("__t")), F.col(col) == F.col("__t"), "left_anti")


def disagreeing(df: DataFrame, col: str, name: str, target: DataFrame, key: str, real: str) -> DataFrame:
    """Rows that carry another name than the row they refer to."""
    t = target.select(F.col(key).alias("__t"), F.col(real).alias("__real"))
    return df.join(t, F.col(col) == F.col("__t")).where(~F.col(name).eqNullSafe(F.col("__real"))).drop("__t").withColumnRenamed("__real", "expected")


def diff(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, change) for each key that was added, removed or changed."""
    side = lambda df, n: df.select(F.col(key), F.xxhash64(*cols).alias(f"__{n}"), F.lit(True).alias(f"__in_{n}"))
    full = side(old, "o").join(side(new, "n"), key, "full")
    change = F.when(F.col("__in_o").isNull(), "added").when(F.col("__in_n").isNull(), "removed").when(F.col("__o") != F.col("__n"), "changed")
    return full.select(key, change.alias("change")).where("change IS NOT NULL")


def version_checks(old: DataFrame, new: DataFrame, key: str, name: str, retired: DataFrame | None = None) -> DataFrame:
    """(key, problem): ids lost, ids renamed, and retired ids that are back."""
    o, n = old.select(key, F.col(name).alias("__o")), new.select(key, F.col(name).alias("__n"))
    lost = o.join(n, key, "left_anti").select(key, F.lit("lost").alias("problem"))
    renamed = o.join(n, key).where("__o <> __n").select(key, F.lit("renamed").alias("problem"))
    out = lost.unionByName(renamed)
    if retired is not None:
        out = out.unionByName(n.join(retired.select(key), key, "left_semi").select(key, F.lit("returned").alias("problem")))
    return out


def unbroken(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Neighbouring ranges between which there is a gap or an overlap; ranges are whole numbers, both ends inclusive."""
    w = Window.orderBy(F.col(low).asc_nulls_first())
    return ranges.withColumn("next_low", F.lead(low).over(w)).where("next_low IS NOT NULL").where(F.coalesce(F.col(high) + 1 != F.col("next_low"), F.lit(True)))


def vocabulary(df: DataFrame, key: str, tags: str, allowed: list[str]) -> DataFrame:
    """(key, tag) for each tag outside the vocabulary."""
    return df.select(key, F.explode(tags).alias("tag")).where(~F.col("tag").isin(allowed))


def progress(df: DataFrame, by: str, status: str, states: list[str]) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == s).alias(s) for s in states))


def collisions(df: DataFrame, name: str, norm: Column, before: Column | None = None) -> DataFrame:
    """(norm, n): normal forms shared by several names; with ``before`` only those that the new normalisation brings about."""
    d = df.select(F.col(name).alias("__name"), norm.alias("norm"), *([before.alias("__before")] if before is not None else [])).distinct()
    agg = [F.count_distinct("__name").alias("n")] + ([F.count_distinct("__before").alias("nb")] if before is not None else [])
    out = d.groupBy("norm").agg(*agg).where("n > 1")
    return out.where("nb > 1").drop("nb") if before is not None else out


def insert_after(rows: DataFrame, new: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, pos): new rows set after their anchor (``after``; null: at the end) in their own order, all renumbered from 1.

    One numbered list, as a catalog file is; its key table goes through one sort.
    """
    last = rows.agg(F.max(pos).alias("__last"))
    at = new.join(rows.select(F.col(key).alias("__a"), F.col(pos).alias("__p")), F.col("after") == F.col("__a"), "left").join(F.broadcast(last))
    placed = at.select(key, F.coalesce("__p", "__last").alias("__major"), F.col("ord").alias("__minor"))
    all_ = rows.select(key, F.col(pos).alias("__major"), F.lit(-1).alias("__minor")).unionByName(placed)
    return all_.select(key, F.row_number().over(Window.orderBy("__major", "__minor")).alias(pos))


def ratio_errors(df: DataFrame, key: str, score: str, base: str, value: str, tolerance: int = 1) -> DataFrame:
    """Rows whose value is further than ``tolerance`` thousandths from score / base."""
    want = F.round(F.col(score) * 1000 / F.col(base)).cast("long")
    return df.select(key, F.round(F.col(value) * 1000).cast("long").alias("milli"), want.alias("want")).where(F.abs(F.col("milli") - F.col("want")) > tolerance)


def bin_counts(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(bin, n) for all bins between the bounds, empty ones with 0; a value on a bound is in the upper bin."""
    b = F.lit(0)
    for x in bounds:
        b = b + F.when(F.col(value) >= x, 1).otherwise(0)
    spark = df.sparkSession
    return spark.range(len(bounds) + 1).select(F.col("id").cast("int").alias("bin")).join(df.groupBy(b.alias("bin")).agg(F.count("*").alias("n")), "bin", "left").fillna(0, ["n"])


def id_order(col: Column) -> Column:
    """The sort key of mixed ids: plain numbers first, then ``ex-`` by number, then the rest as text."""
    plain, ex = F.rlike(col, F.lit(r"^\d+$")), F.rlike(col, F.lit(r"^ex-\d+$"))
    kind = F.when(plain, 0).when(ex, 1).otherwise(2)
    number = F.when(plain | ex, F.regexp_extract(col, r"(\d+)$", 1).cast("long")).otherwise(0)
    return F.struct(kind.alias("kind"), number.alias("number"), F.when(kind == 2, col).otherwise("").alias("text"))


def abbreviations(names: DataFrame, short: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, problem): names without an abbreviation, too long or repeated ones, and ones for unknown names."""
    j = names.select(key).join(short, key, "left")
    twice = repeated(short, "abbr").select("abbr")
    return (
        j.where("abbr IS NULL").select(key, F.lit("missing").alias("problem"))
        .unionByName(short.where(F.length("abbr") > limit).select(key, F.lit("too long").alias("problem")))
        .unionByName(short.join(twice, "abbr", "left_semi").select(key, F.lit("repeated").alias("problem")))
        .unionByName(short.join(names.select(key), key, "left_anti").select(key, F.lit("unknown").alias("problem")))
    )


def tag_disagreements(df: DataFrame, key: str, tags: str, text: str, words: dict[str, str]) -> DataFrame:
    """(key, lacking, extra): tags whose word the text has but the row lacks, and the reverse; ``words`` gives each tag's word."""
    named = F.filter(F.array(*(F.when(F.contains(F.col(text), F.lit(w)), F.lit(t)) for t, w in words.items())), lambda x: x.isNotNull())
    known = F.array_intersect(tags, F.array(*map(F.lit, words)))
    out = df.select(key, F.array_sort(F.array_except(named, known)).alias("lacking"), F.array_sort(F.array_except(known, named)).alias("extra"))
    return out.where((F.size("lacking") > 0) | (F.size("extra") > 0))
