"""Connected components by alternating large-star and small-star steps on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.tables import free, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a, b.  Point each neighbour that is larger (or else smaller) than a node at the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written, so that the join can split a node with very many neighbours
    least = stash(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = stash(out.where("a > b").distinct(), "edges")
    free(least)
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether each a has one edge and no b is an a: then b is what a reaches."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (any order).  Every node that has an edge, with the least node it reaches: node, component_id."""
    now = stash(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        wide = _star(now, True)
        free(now)
        now = _star(wide, False)
        free(wide)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct())
