"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long), in any direction, repeats and loops allowed -> (node, root), root the least node reachable.

    Every node has an edge to its root at the end, and none other: the edge set has stopped changing. Each round is two
    joins on pre-aggregated minima, so a centre with very many neighbours is split by Spark's skew handling; edges are
    checkpointed to the shared folder after each round. Loops and nulls are dropped, no edges give no rows.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct())
        if after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
