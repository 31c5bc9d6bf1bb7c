"""Connected components over an edge table, with no step on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.storage import cut, holding, release


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


#: A node with more than this share of all edges is a hub; so there are at most 2 / HUB hubs.
HUB = 0.005


def _with_low(rows: DataFrame, low: DataFrame, edges: int) -> DataFrame:
    """``rows`` (u, v) with the minimum ``m`` of u. ``low`` holds u, m and n, the edges at u.

    All rows of a hub would meet in one task; the at most 2 / HUB hubs are broadcast instead.
    """
    hubs = F.broadcast(low.where(F.col("n") > HUB * edges).select("u", "m"))
    rest = low.where(F.col("n") <= HUB * edges).select("u", "m")
    return rows.join(hubs, "u").select("u", "v", "m").union(rows.join(rest, "u").select("u", "v", "m"))


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_low(both.where("v > u"), low, edges).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return (
        _with_low(e.select("u", "v"), low, edges).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` that is not itself the smallest of its component.

    Alternates large-star and small-star steps until the edges are stars around each component's smallest node; the
    number of rounds grows with the logarithm of the longest path. Every round is two grouped minima (combined on the
    map side) and joins in which hubs go by broadcast; its edges are written to the shared folder, so the lineage
    stays one round long and a lost executor costs one round. Self loops and null ends are ignored; an empty edge table
    gives an empty result.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    was = _state(e)
    while was[0]:
        large = cut(_large_star(e, was[0]), "edges")
        new = cut(_small_star(large, was[0]), "edges")
        release(large)
        now = _state(new)
        release(e)
        e = new
        if now == was:
            break
        was = now
    return holding(e.select(F.col("u").alias("node"), F.col("v").alias("root")), e)
