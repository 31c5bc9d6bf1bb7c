"""Operations analytics: shard plans, timings, selections, scans for personal data."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: An address is a name, an at sign and a domain. A name is words with single dots between them; a domain is labels with
#: dots between, of letters, digits and inner hyphens, the last of letters only. Lengths are those that mail allows.
_NAME_WORD = "[0-9A-Za-z_%+-]{1,64}"
_LABEL = "[0-9A-Za-z](?:[0-9A-Za-z-]{0,61}[0-9A-Za-z])?"
EMAIL = f"({_NAME_WORD}(?:[.]{_NAME_WORD})*+@(?:{_LABEL}[.])+[A-Za-z]{{2,63}}(?![0-9A-Za-z]))"
#: A folder of users, with either kind of slash, and the name below it.
USER_PATH = r"((?:/Users/|/home/|\\Users\\)[\w.-]*)"
#: A drive letter that no word character precedes.
DRIVE = r"(?:^|[^A-Za-z0-9_])([A-Za-z]:\\)"


def longest_first(weights: list[tuple[float, int]], shards: int) -> dict[int, int]:
    """Item number -> shard: heaviest first, each to the least loaded shard; equals by smaller number and smaller shard."""
    heap = [(0.0, s) for s in range(shards)]
    out = {}
    for w, no in sorted(weights, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        out[no] = s
        heapq.heappush(heap, (load + w, s))
    return out


def shard_plan(jobs: DataFrame, by: str, shards: int) -> DataFrame:
    """(by, no, shard) for jobs (by, no, sec) of each plan; jobs without a time take the median, without any time no % shards."""
    kind = jobs.schema[by].dataType.simpleString()

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        known = t["sec"].dropna()
        if known.empty:
            return pd.DataFrame({by: key[0], "no": t["no"], "shard": t["no"] % shards})
        sec = t["sec"].fillna(known.median())
        plan = longest_first(list(zip(sec, t["no"])), shards)
        return pd.DataFrame({by: key[0], "no": t["no"], "shard": t["no"].map(plan)})

    return jobs.select(by, "no", "sec").groupBy(by).applyInPandas(run, f"{by} {kind}, no long, shard long")


def timing_shares(df: DataFrame, title: str, seconds: str, k: int = 20) -> DataFrame:
    """The ``k`` longest titles with their share of the total in percent."""
    per = df.groupBy(title).agg(F.sum(seconds).alias("sec"))
    total = per.agg(F.sum("sec").alias("__all"))
    return per.join(F.broadcast(total)).select(title, "sec", F.round(100 * F.col("sec") / F.col("__all"), 1).alias("percent")).orderBy(F.desc("sec"), title).limit(k)


def personal_data(df: DataFrame, key: str, text: str, exempt: list[str] = ()) -> DataFrame:
    """(key, kind, found): user paths, drive letters and e-mail addresses, without exempt ones."""
    t = F.col(text)
    none = F.array().cast("array<struct<kind:string,found:string>>")

    def every(kind: str, pattern: str, *needs: str) -> Column:
        """All matches; the pattern is tried only on texts that hold one of ``needs``."""
        may = F.contains(t, F.lit(needs[0]))
        for n in needs[1:]:
            may |= F.contains(t, F.lit(n))
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found")))
        return F.when(may, found).otherwise(none)

    paths = every("path", USER_PATH, "/Users/", "/home/", "\\Users\\")
    hits = df.select(key, F.explode(F.concat(every("email", EMAIL, "@"), paths, every("drive", DRIVE, ":\\"))).alias("h"))
    out = hits.select(key, "h.*").distinct()
    return out.where(~F.col("found").isin(list(exempt))) if exempt else out


def selective_terms(docs: DataFrame, key: str, terms: Column, query: DataFrame, cap: int) -> DataFrame:
    """(key, score): documents scored by 1 / (document frequency) of each query term they hold; terms in over ``cap`` documents count nothing."""
    t = docs.select(key, F.explode(F.array_distinct(terms)).alias("term")).join(F.broadcast(query.select("term").distinct()), "term", "left_semi")
    df = t.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= cap)
    return t.join(df, "term").groupBy(key).agg(F.sum(1 / F.col("df")).alias("score"))


def estimate(jobs: DataFrame, times: DataFrame, shard: str) -> DataFrame:
    """Seconds of each shard; jobs without a time count as the median."""
    mid = times.agg(F.median("sec").alias("__mid"))
    return jobs.join(times, "no", "left").join(F.broadcast(mid)).groupBy(shard).agg(F.sum(F.coalesce("sec", "__mid")).alias("sec"))


def recent(df: DataFrame, by: str, order: list, k: int = 3) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__k") <= k).drop("__k")


def newest_if_unseen(df: DataFrame, by: str, at: str, fresh: Column, seen: str) -> DataFrame:
    """The newest fresh row of each key, if any fresh row is unseen."""
    w = Window.partitionBy(by)
    f = df.where(fresh).withColumn("__u", F.max((~F.col(seen)).cast("int")).over(w)).where("__u = 1")
    return f.withColumn("__k", F.row_number().over(w.orderBy(F.desc(at)))).where("__k = 1").drop("__k", "__u")


def ordinals(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``nth``: which occurrence of its key a row is."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def overridden(auto: DataFrame, manual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, origin): a manual value beats the automatic one."""
    m = manual.select(key, F.col(value).alias("__m"))
    return auto.join(m, key, "full").select(key, F.coalesce("__m", value).alias(value), F.when(F.col("__m").isNotNull(), "manual").otherwise("auto").alias("origin"))


def last_rows(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("__k") <= n).drop("__k")


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
