"""Pairs of readers, side tables on windows, and codes (J14-J16, WS19-WS21, F-M9, SC20, SE7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import SUBJECT, global_rank, portable_key
from .volume import AXES, scaled_windows, zoom
from .windows import uniform_windows

_c = F.col


def pairwise(fixed: DataFrame, moving: DataFrame, key: str = SUBJECT) -> DataFrame:
    """Two readers' rows of the same subject side by side; columns of the second end in _moving."""
    other = moving.withColumnsRenamed({c: f"{c}_moving" for c in moving.columns if c != key})
    return fixed.join(other, key)


def with_side_table(windows: DataFrame, rows: DataFrame, key: str = SUBJECT) -> DataFrame:
    """J15, WS21: any sampler's windows with the subject's label or feature rows; a subject without rows keeps its windows."""
    return windows.join(rows, key, "left")


def self_pairs(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Every row with a pseudo-random other row, never itself: the next one in a portable order, ends joined.

    Two total orders of ranks and an equi-join; no cross join.
    """
    ranked = global_rank(rows.select(key), [portable_key(_c(key) * 7919 + seed), _c(key)])
    n = ranked.agg(F.count("*").alias("__n"))
    x = ranked.join(F.broadcast(n)).where("__n > 1").select(_c(key).alias("x"), ((_c("rank") % _c("__n")) + 1).alias("rank"))
    return x.join(ranked.select(_c(key).alias("y"), "rank"), "rank").select("x", "y")


def pairwise_windows(fixed: DataFrame, moving: DataFrame, key: str, window: tuple[int, int, int], n: int, seed: int = 0) -> DataFrame:
    """WS19: the same uniform windows of both images of a pair; image tables hold (key, X, Y, Z) and must agree in size."""
    same = fixed.join(moving.select(key, *[_c(a).alias(f"__{a}") for a in "XYZ"]), key)
    for a in "XYZ":
        same = same.where(_c(a) == _c(f"__{a}"))
    return uniform_windows(same.select(key, "X", "Y", "Z"), key, window, n, seed)


def pairwise_resized(fixed: DataFrame, moving: DataFrame, keys: list[str], fixed_shape, moving_shape, window: tuple[int, int, int]) -> DataFrame:
    """WS20: the moving volume zoomed linearly to the fixed one's shape, and both scaled to one window: fixed, moving by voxel."""
    as_fixed = zoom(moving, keys, moving_shape, fixed_shape, 1)
    a, b = (scaled_windows(v, keys, fixed_shape, window) for v in (fixed, as_fixed))
    return a.withColumnRenamed("value", "fixed").join(b.withColumnRenamed("value", "moving"), [*keys, *AXES])


def categorical(rows: DataFrame, label: str, name: str = "code") -> DataFrame:
    """F-M9: labels as codes 0, 1, ... in sorted order; null stays null."""
    known = rows.where(_c(label).isNotNull()).select(label).distinct()
    codes = global_rank(known, [_c(label)]).select(_c(label).alias("__l"), (_c("rank") - 1).cast("int").alias(name))
    return rows.join(codes, rows[label] == codes["__l"], "left").drop("__l")


def fetched(rows: DataFrame, key: str, order: str = "sequential", seed: int = 0) -> DataFrame:
    """SC20: rows with the `position` in which a reader would give them: by key, or in a portable pseudo-random order."""
    by = [_c(key)] if order == "sequential" else [portable_key(_c(key) * 7919 + seed), _c(key)]
    return global_rank(rows, by).withColumn("position", _c("rank") - 1).drop("rank")


def constraints(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """SE7: parameter constraints of several tables intersected: one value a key; a conflict is marked, its value null."""
    rows = tables[0].select(key, value)
    for t in tables[1:]:
        rows = rows.unionByName(t.select(key, value))
    ends = rows.where(_c(value).isNotNull()).groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    conflict: Column = _c("lo") != _c("hi")
    return ends.select(key, F.when(~conflict, _c("lo")).alias(value), conflict.alias("conflict"))


def running_index(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """A 0-based index inside each group."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
