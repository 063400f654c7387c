"""Intensity statistics and preprocessing (AG54-AG65, F-M1-F-M15, PF8, PF9, SE6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import cumulated, linear, plotting, quantiles, same_keys

_c = F.col
#: The percentiles of the 13 landmarks between the cutoffs, and the landmarks that each kind uses.
INNER = (0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9)
LANDMARKS = {"percentile": (0, 1, 2, 4, 5, 6, 7, 8, 10, 11, 12), "quartile": (0, 3, 6, 9, 12), "median": (0, 6, 12)}


#: The default cutoff, and the bounds that keep cutoffs outside the inner landmarks, by kind.
DEFAULT_CUTOFF = (0.01, 0.99)
CUTOFF_BOUNDS = {"quartile": (0.24, 0.76)}
OTHER_BOUNDS = (0.09, 0.91)


def standard_cutoff(cutoff: tuple[float, ...], kind: str = "percentile") -> tuple[float, float]:
    """F-M2: the least and largest cutoff within [0, 1], the low one at most and the high one at least at the bounds of
    the kind; fewer than two different values give the default cutoff."""
    if len(cutoff) < 2 or len(cutoff) > 2 and len(set(cutoff)) < 2:
        return DEFAULT_CUTOFF
    most_low, least_high = CUTOFF_BOUNDS.get(kind, OTHER_BOUNDS)
    return min(max(0.0, min(cutoff)), most_low), max(min(1.0, max(cutoff)), least_high)


def landmarks(df: DataFrame, keys: list[str], value: str, cutoff: tuple[float, ...] = DEFAULT_CUTOFF, kind: str = "percentile") -> DataFrame:
    """AG62: an array of 13 exact percentiles of each group, linearly interpolated, between the standard cutoffs."""
    low, high = standard_cutoff(cutoff, kind)
    names = [f"__p{i}" for i in range(len(INNER) + 2)]
    found = quantiles(df, keys, _c(value), {n: linear(p) for n, p in zip(names, (low, *INNER, high), strict=True)})
    return found.select(*keys, F.when(_c(names[0]).isNotNull(), F.array(*names)).alias("landmarks"))


def averaged_mapping(marks: DataFrame, by: list[str]) -> DataFrame:
    """AG63, AG64: landmarks mapped to [0, 100] by each subject's ends, averaged over the subjects of a group.

    A subject whose ends coincide has slope 0. Returns by, mapping.
    """
    m = _c("landmarks")
    slope = F.coalesce(F.try_divide(F.lit(100.0), m[12] - m[0]), F.lit(0.0))
    rows = marks.select(*by, F.posexplode(F.transform(m, lambda v: (v - m[0]) * slope)).alias("k", "v"))
    means = rows.groupBy(*by, "k").agg(F.avg("v").alias("v"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("mapping"))


def standardised(df: DataFrame, keys: list[str], value: str, marks: DataFrame, mapping: DataFrame, by: list[str], kind: str = "percentile", name: str = "standard") -> DataFrame:
    """F-M1: piecewise linear mapping of values through a subject's landmarks to the group's; ends extrapolate,
    segments of no width have slope 0."""
    return mapped(df.join(marks, keys).join(F.broadcast(mapping), by), value, kind, name)


def mapped(joined: DataFrame, value: str, kind: str = "percentile", name: str = "standard") -> DataFrame:
    """F-M1 on rows that carry their `landmarks` and `mapping`, which are dropped."""
    take = LANDMARKS[kind]
    a, b = F.array(*[_c("landmarks")[i] for i in take]), F.array(*[_c("mapping")[i] for i in take])
    seg = F.size(F.filter(F.slice(a, 2, len(take) - 2), lambda t: t <= _c(value)))
    slope = F.coalesce(F.try_divide(F.get(b, seg + 1) - F.get(b, seg), F.get(a, seg + 1) - F.get(a, seg)), F.lit(0.0))
    return joined.withColumn(name, F.get(b, seg) + slope * (_c(value) - F.get(a, seg))).drop("landmarks", "mapping")


def whitened(df: DataFrame, keys: list[str], value: str, mask: Column | None = None, name: str = "white") -> DataFrame:
    """F-M4, F-M5: (v - mean) / max(std, 1e-5), both over the masked values of the group."""
    stats = df.where(mask) if mask is not None else df
    stats = stats.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(stats, keys, "left").withColumn(name, (_c(value) - _c("__m")) / F.greatest("__s", F.lit(1e-5))).drop("__m", "__s")


def otsu(df: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """AG65: the threshold (a bin centre) that maximises w1 * w2 * (m1 - m2)^2, the first of equals; by group.

    Two aggregates and two windows over at most `bins` rows a group.
    """
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (_c("hi") - _c("lo")) / bins
    bin_ = F.least(F.coalesce(F.floor(F.try_divide(_c(value) - _c("lo"), width)), F.lit(0)), F.lit(bins - 1))
    hist = df.join(ends, keys).groupBy(*keys, "lo", "hi", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    hist = hist.withColumn("centre", _c("lo") + (_c("bin") + 0.5) * width)
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    total = _c("n") * _c("centre")
    rows = hist.select(*keys, "bin", "centre", F.sum("n").over(below).alias("w1"), F.sum(total).over(below).alias("s1"), F.sum("n").over(whole).alias("w"), F.sum(total).over(whole).alias("s"))
    m1, m2, w2 = _c("s1") / _c("w1"), F.try_divide(_c("s") - _c("s1"), _c("w") - _c("w1")), _c("w") - _c("w1")
    rows = rows.withColumn("score", F.round(F.coalesce(_c("w1") * w2 * F.pow(m1 - m2, 2), F.lit(0.0)), 6))
    return rows.groupBy(*keys).agg(F.max_by("centre", F.struct("score", -_c("bin"))).alias("threshold"))


def foreground(df: DataFrame, keys: list[str], value: str, kind: str = "mean_plus", threshold: float = 0.0) -> DataFrame:
    """PF8: a boolean `mask` by threshold_plus/minus, otsu_plus/minus or mean_plus."""
    if kind.startswith("threshold"):
        marked = df.withColumn("__t", F.lit(float(threshold)))
    elif kind.startswith("otsu"):
        marked = df.join(otsu(df, keys, value).withColumnRenamed("threshold", "__t"), keys, "left")
    elif kind == "mean_plus":
        marked = df.join(df.groupBy(*keys).agg(F.avg(value).alias("__t")), keys, "left")
    else:
        raise ValueError(f"unknown mask: {kind}")
    return marked.withColumn("mask", _c(value) < _c("__t") if kind.endswith("minus") else _c(value) > _c("__t")).drop("__t")


def fused(masks: DataFrame, voxel: list[str], how: str = "and") -> DataFrame:
    """PF9, SE6: masks of several modalities fused by voxel; "multi" keeps them apart."""
    if how == "multi":
        return masks
    return masks.groupBy(*voxel).agg((F.bool_and if how == "and" else F.bool_or)("mask").alias("mask"))


def equalised_luma(df: DataFrame, keys: list[str], r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """F-M7: histogram equalisation on BT.601 luma: adds y (0..255) and y_equal by the cumulative histogram."""
    y = F.rint(0.299 * _c(r) + 0.587 * _c(g) + 0.114 * _c(b)).cast("int")
    rows = df.withColumn("y", y)
    hist = rows.groupBy(*keys, "y").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(*keys)
    table = hist.withColumn("c", below).withColumn("c0", F.min("c").over(whole)).withColumn("all", F.sum("n").over(whole))
    new = F.coalesce(F.rint(F.try_divide((_c("c") - _c("c0")) * 255.0, _c("all") - _c("c0"))), F.lit(0.0)).cast("int")
    return rows.join(table.select(*keys, "y", new.alias("y_equal")), [*keys, "y"])


def region_stats(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """AG54-AG58: minimum, maximum, mean, std, weighted mean, skewness, excess kurtosis and median by group (population)."""
    v = _c(value).cast("double")
    w = weight.cast("double") if weight is not None else F.lit(1.0)
    moments = df.groupBy(*keys).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.try_divide(F.sum(v * w), F.sum(w)).alias("weighted_mean"),
        F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
    )
    return same_keys(moments, cumulated(df, keys, v).groupBy(*keys).agg(linear(0.5).alias("median")), keys, "left")


def mquantiles(df: DataFrame, keys: list[str], value: str, probabilities: tuple[float, ...] = (0.25, 0.75)) -> DataFrame:
    """AG59: quantiles with plotting positions 0.4, 0.4 by group: the order statistics around n p + 0.4 + 0.2 p.
    All quantiles of a single value are that value; a group without values has no row.
    """
    return cumulated(df.where(_c(value).isNotNull()), keys, _c(value)).groupBy(*keys).agg(*[plotting(p).alias(f"q{int(100 * p)}") for p in probabilities])


def smooth_threshold(v: Column, t: Column, mode: str = "high") -> Column:
    """F-M3: values beyond t bent exponentially towards it."""
    return F.when(v > t, t + 1 - F.exp(t - v)).otherwise(v) if mode == "high" else F.when(v < t, t - 1 + F.exp(v - t)).otherwise(v)


def activation(x: Column, name: str) -> Column:
    """F-M14: the parameter-free activations."""
    zero = F.lit(0.0)
    # fixed values: the scale and the alpha of selu
    return {
        "relu": lambda: F.greatest(x, zero), "relu6": lambda: F.least(F.greatest(x, zero), F.lit(6.0)), "elu": lambda: F.when(x > 0, x).otherwise(F.exp(F.least(x, zero)) - 1),
        "softplus": lambda: F.greatest(x, zero) + F.log1p(F.exp(-F.abs(x))), "softsign": lambda: x / (F.abs(x) + 1), "sigmoid": lambda: 1 / (1 + F.exp(-x)), "tanh": lambda: F.tanh(x),
        "selu": lambda: F.lit(1.0507009873554805) * F.when(x > 0, x).otherwise(F.lit(1.6732632423543772) * (F.exp(F.least(x, zero)) - 1)), "leakyrelu": lambda: 0.51 * x + 0.49 * F.abs(x),
    }[name]()


def softmax(values: Column) -> Column:
    """F-M8: softmax of an array, shifted by its maximum."""
    e = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, t: s + t))


def argmax(values: Column) -> Column:
    """F-M8, SO9: the first position of the maximum of an array, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(code: Column, classes: int, kind: str = "double") -> Column:
    """F-M10, LO1: an array with 1 at the code's place."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == code).cast(kind))


def tiled(value: Column, n: int) -> Column:
    """F-M11."""
    return F.array_repeat(value, n)


def mixup(a: Column, b: Column, f: float) -> Column:
    """F-M12 with the factor given: a * f + b * (1 - f)."""
    return a * f + b * (1 - f)


def error_map(a: Column, b: Column, squared: bool = True) -> Column:
    """F-M13."""
    return F.pow(a - b, 2) if squared else F.abs(a - b)


def decayed_rate(iteration: Column, rate: float) -> Column:
    """F-M15: a learning rate halved after every third iteration."""
    return F.lit(rate) * F.pow(F.lit(0.5), F.floor(iteration / 3))
