"""Roots of linked nodes inside groups, by distributed star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def roots(edges: DataFrame, keys: list[str]) -> DataFrame:
    """edges (keys, u long, v long), in any direction -> (keys, node, root), root the least node reachable in its group.

    Alternating large-star and small-star steps: each is two joins on minima that are aggregated map-side, and edges are
    checkpointed after each round. It ends when a round leaves the set of edges as it is. Loops and nulls are dropped.
    """
    at = [*keys, "u"]
    edges = cut(edges.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*at).agg(F.min("v").alias("m")).select(*at, F.least("u", "m").alias("m"))
        large = both.join(least, at).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*at).agg(F.min("v").alias("m"))
        small = large.join(least, at).where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(*keys, "u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct())
        if after.count() == edges.count() and after.join(edges, [*keys, "u", "v"], "left_anti").isEmpty():
            break
        edges = after
    return edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct())
