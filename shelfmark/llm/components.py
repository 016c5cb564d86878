"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut, small


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of each node, and the node, on the least of them.

    The minimum is a partial aggregate; joining it back to the edges is a plain
    equi-join, whose hot keys adaptive execution can split.
    """
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each u hangs on one v, and no v hangs on another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down > 0 and up > 0").isEmpty()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Edges (u, v) of longs -> (node, component): the least node that each node can reach.

    Self-loops, repeated and reversed edges are allowed; nodes without another
    node are not in the result.  The edges are cut to the shared folder after each
    round; whether any node is left between two others is all that the driver learns.
    """
    e = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(e):
            break
        e = cut(_star(_star(e, True), False))
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(comp: DataFrame, links: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """``comp`` (node, component) after ``links`` (u, v) between components; only the components they name are contracted."""
    joined = cut(components(links))
    to = joined.select(F.col("node").alias("_from"), F.col("component").alias("_to"))
    moved = comp.join(small(to, max_broadcast), F.col("component") == F.col("_from"), "left")
    moved = moved.select("node", F.coalesce("_to", "component").alias("component"))
    return cut(moved.unionByName(joined.join(comp.select("node"), "node", "left_anti")))
