"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.storage import cut, holding, release


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b) that are not the smallest of their component.

    Every node points at the smallest neighbour that it knows, and each round replaces that by what it points at in
    turn, so paths halve. A round hands a pointer to both ends of every edge that still joins different roots, which
    drops the others. Rounds are written to the shared folder; nulls and self loops are ignored.
    """
    e = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    live, point = cut(e, "edges"), None
    while not live.isEmpty():
        # Of each root the smallest root that an edge leads to; smaller roots point at nothing, so there are no rings.
        hook = live.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("to"))
        flat = cut(hook, "hooks")
        while True:
            up = flat.alias("x").join(flat.alias("y"), F.col("x.to") == F.col("y.node"), "left")
            new = cut(up.select("x.node", F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved")), "hooks")
            release(flat)
            flat = new
            if flat.where("moved").isEmpty():
                break
        flat = holding(flat.select("node", "to"), flat)
        if point is None:
            point = flat
        else:
            moved = point.alias("p").join(flat.alias("h"), F.col("p.to") == F.col("h.node"), "left")
            new = cut(moved.select("p.node", F.coalesce("h.to", "p.to").alias("to")).unionByName(flat), "roots")
            release(point, flat)
            point = new
        ends = live
        for c in ("u", "v"):
            ends = ends.join(point.select(F.col("node").alias(c), F.col("to").alias(f"{c}r")), c, "left").withColumn(c, F.coalesce(f"{c}r", c)).drop(f"{c}r")
        new = cut(ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        release(live)
        live = new
    if point is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return holding(point.select("node", F.col("to").alias("root")), point)
