"""How the engine's entities are read from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.operators import lineage
from lodeframe.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


#: (pid, skill, star): a customer's brands; the star is the number of purchases, 3 at most, unknown for some.
STARS = """stars AS (SELECT o_custkey AS pid, p_brand AS skill,
    (CASE WHEN sum(l_linenumber) % 7 = 0 THEN -1 ELSE least(3, count(*)) END)::INT AS star
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand)"""

#: (pid, skill, own, g1, g2): with the linked customers behind a customer's key by 1 and by 7.
FAMILY = f"""{STARS},
  roles AS (SELECT c_custkey AS pid, skill, star, 'own' AS role FROM customer JOIN stars ON pid = c_custkey
    UNION ALL SELECT c_custkey, skill, star, 'g1' FROM customer JOIN stars ON pid = c_custkey + 1
    UNION ALL SELECT c_custkey, skill, star, 'g2' FROM customer JOIN stars ON pid = c_custkey + 7),
  family AS (SELECT pid, skill, max(CASE role WHEN 'own' THEN star END) AS own, max(CASE role WHEN 'g1' THEN star END) AS g1,
    max(CASE role WHEN 'g2' THEN star END) AS g2 FROM roles GROUP BY pid, skill)"""


def ok_sql(star: str, threshold: int) -> str:
    return f"coalesce(CASE WHEN {star} < 0 THEN {str(threshold == 1).upper()} ELSE {star} >= {threshold} END, FALSE)"


def counted_sql(star: str, threshold: int) -> str:
    return f"coalesce(CASE WHEN {star} < 0 THEN {int(threshold == 1)} WHEN {star} >= {threshold} THEN {star} ELSE 0 END, 0)"


def stars(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    star = F.when(F.sum("l_linenumber") % 7 == 0, -1).otherwise(F.least(F.lit(3), F.count("*")))
    return j.groupBy(F.col("o_custkey").alias("pid"), F.col("p_brand").alias("skill")).agg(star.cast("int").alias("star"))


def parents(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") + 1).alias("g1"), (F.col("c_custkey") + 7).alias("g2"), "c_mktsegment", "c_nationkey", "c_acctbal", "c_name")


def family(spark: SparkSession, d: str) -> DataFrame:
    return lineage.members(parents(spark, d), stars(spark, d), "pid", {"g1": "g1", "g2": "g2"}, "skill", "star")


def brand_number():
    """Brands are numbered by what stands behind the mark."""
    return F.regexp_extract("skill", r"(\d+)$", 1).cast("int")


#: A read of a part's name with a deterministic misspelling, and the dictionary of all different names.
#: The dictionary also has the red names with one of two letters behind, between which some reads lie.
READS = """reads AS (SELECT p_partkey AS id, p_name AS truth, CASE p_partkey % 7
    WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'i', 'l') WHEN 2 THEN p_name || 'x' WHEN 3 THEN substr(p_name, 2)
    WHEN 4 THEN replace(replace(p_name, 'o', '0'), 'e', 'c') WHEN 5 THEN p_name || ' c' ELSE reverse(p_name) END AS norm FROM part),
  dict AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT p_name || s FROM part, (VALUES (' a'), (' b')) t(s) WHERE p_name LIKE 'red%'),
  limits AS (SELECT name, CASE WHEN length(name) <= 2 THEN 0 WHEN length(name) <= 5 THEN 1 WHEN length(name) <= 9 THEN 2 ELSE 3 END AS lim FROM dict)"""


def reads(spark: SparkSession, d: str) -> DataFrame:
    p, n = table(spark, d, "part"), F.col("p_name")
    k = F.col("p_partkey") % 7
    text = (
        F.when(k == 0, n).when(k == 1, F.replace(n, F.lit("i"), F.lit("l"))).when(k == 2, F.concat(n, F.lit("x")))
        .when(k == 3, F.expr("substring(p_name, 2)"))
        .when(k == 4, F.translate(n, "oe", "0c")).when(k == 5, F.concat(n, F.lit(" c"))).otherwise(F.reverse(n))
    )
    return p.select(F.col("p_partkey").alias("id"), n.alias("truth"), text.alias("norm"))


def names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    more = n.where("name LIKE 'red%'").select(F.explode(F.array(*(F.concat("name", F.lit(x)) for x in (" a", " b")))).alias("name"))
    return n.union(more).withColumn("norm", F.col("name"))


#: Frames of a user's events in order of time, the value as a position signal.
def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("who"), "event_id", "ts", "event_type", "value")
