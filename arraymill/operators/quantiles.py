"""Exact quantiles of groups of any size (AG58, AG59, AG62, SE6).

Equal values are counted first, in the tasks that hold them. The distinct values of all groups are then range-partitioned
by group and value; counts are summed up inside a part and shifted by the parts before it. So a large group spreads over
many parts, and no task or aggregation buffer holds a group. What comes out of a group are the few values whose ranks
are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

_c = F.col


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys that may be null; right's keys are dropped."""
    renamed = right.select(*[_c(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    if not keys:
        return left.join(renamed, F.lit(True), how)
    on = left[keys[0]].eqNullSafe(renamed["__k0"])
    for i, k in enumerate(keys[1:], 1):
        on = on & left[k].eqNullSafe(renamed[f"__k{i}"])
    return left.join(renamed, on, how).drop(*[f"__k{i}" for i in range(len(keys))])


def _counts(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, v, n: the distinct values of each group and how often each occurs; nulls are one row of n = 0, so that a
    group without values stays."""
    counts = df.select(*keys, value.cast("double").alias("v")).groupBy(*keys, "v")
    return counts.agg(F.count("v").alias("n"))


def cumulated(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, v, n, upto, total: the distinct values of each group, how often each occurs, how many values are not above it,
    and how many there are. The parts are checkpointed: their bounds come from a sample."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(_counts(df, keys, value).repartitionByRange(parts, *keys, "v").withColumn("__part", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy(*keys, "__part").agg(F.sum("n").alias("__c"))
    base = held.select(*keys, "__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"), F.sum("__c").over(group).alias("total"))
    inside = Window.partitionBy("__part", *keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = same_keys(placed.withColumn("upto", F.sum("n").over(inside)), base, [*keys, "__part"])
    return rows.select(*keys, "v", "n", (_c("upto") + _c("__base")).alias("upto"), "total")


def cumulated_few(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The same table for values of which a group has few different ones, however often they occur: one window over the
    distinct values of a group, no range partition."""
    group = Window.partitionBy(*keys)
    upto = group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return _counts(df, keys, value).select(*keys, "v", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("total"))


def _at(rank: Column, share: Column) -> Column:
    """What a row of `cumulated` adds to the value of a rank (from 0) that counts by a share; null where it has no part."""
    return F.when((rank >= _c("upto") - _c("n")) & (rank < _c("upto")) & (share != 0), _c("v") * share)


def _between(low: Column, rest: Column) -> Column:
    """The sum over a group's rows of the values of two neighbouring ranks, the upper one counting by `rest`."""
    parts = [_at(low, 1 - rest), _at(low + 1, rest)]
    return F.sum(F.when(parts[0].isNotNull() | parts[1].isNotNull(), F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0))))


def linear(probability: float) -> Column:
    """An aggregate over `cumulated`: the quantile between the order statistics around (n - 1) p."""
    at = (_c("total") - 1) * F.lit(float(probability))
    return _between(F.floor(at), at - F.floor(at))


def plotting(probability: float, a: float = 0.4, b: float = 0.4) -> Column:
    """An aggregate over `cumulated`: the quantile with plotting positions a and b; that of a single value is the value."""
    at = _c("total") * F.lit(float(probability)) + F.lit(a + probability * (1 - a - b))
    k = F.floor(F.greatest(F.least(at, _c("total") - 1), F.lit(1.0)))
    rest = F.greatest(F.least(at - k, F.lit(1.0)), F.lit(0.0))
    return _between(k - 1, F.when(_c("total") == 1, F.lit(0.0)).otherwise(rest))


def quantiles(df: DataFrame, keys: list[str], value: Column, named: dict[str, Column]) -> DataFrame:
    """keys and one column a quantile, for every group of df; null for a group without values."""
    return cumulated(df, keys, value).groupBy(*keys).agg(*[q.alias(name) for name, q in named.items()])
