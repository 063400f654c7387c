"""Iterations, bounded histories and early stopping (ST4, ST8-ST15, SO7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("mean", "robust_mean", "median", "generalisation_loss", "median_smoothing", "validation_up")


def iterations(spark, first: int, last: int, every: int = 0, validations: int = 0) -> DataFrame:
    """ST4: (iteration, phase, k): training iterations first + 1 .. last, and `validations` after every `every`-th."""
    rows = spark.range(first + 1, last + 1).select(F.col("id").alias("iteration"))
    training = rows.select("iteration", F.lit("training").alias("phase"), F.lit(0).alias("k"))
    if every <= 0 or validations <= 0:
        return training
    due = rows.where((F.col("iteration") > 0) & (F.col("iteration") % every == 0))
    return training.unionByName(due.select("iteration", F.lit("validation").alias("phase"), F.explode(F.sequence(F.lit(1), F.lit(validations))).alias("k")))


def schedules(runs: DataFrame, keys: list[str], first: Column, last: Column, every: Column, validations: Column) -> DataFrame:
    """ST4 for a table of runs: (keys, iteration, phase, k) of each, as `iterations` has them; the numbers are columns."""
    rows = runs.select(*keys, first.alias("__f"), last.alias("__l"), every.alias("__e"), validations.alias("__v")).where("__l > __f")
    rows = rows.withColumn("iteration", F.explode(F.sequence(F.col("__f") + 1, F.col("__l"))))
    due = (F.col("__e") > 0) & (F.col("__v") > 0) & (F.col("iteration") > 0) & (F.try_mod(F.col("iteration"), F.col("__e")) == 0)
    ks = F.when(due, F.sequence(F.lit(0), F.col("__v").cast("int"))).otherwise(F.array(F.lit(0)))
    return rows.select(*keys, "iteration", F.explode(ks).alias("k")).withColumn("phase", F.when(F.col("k") == 0, "training").otherwise("validation"))


def histories(rows: DataFrame, keys: list[str], order: list[str], loss: str, patience: int) -> DataFrame:
    """ST8, SO7: rows with `history`, the last `patience` losses of the key up to the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - patience, 0)
    return rows.withColumn("history", F.collect_list(loss).over(w))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once: a lambda variable holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def _quantile(a: Column, q: float) -> Column:
    """Linear quantile of an array."""

    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(q)
        low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return _let(F.sort_array(a), of)


def generalisation_loss(a: Column) -> Column:
    """ST12: (last - min) / (max - min), the last value itself where the minimum is 0."""
    last, low, high = F.element_at(a, -1), F.array_min(a), F.array_max(a)
    return F.when(low == 0, last).otherwise(F.try_divide(last - low, high - low))


def _median_filtered(a: Column, size: int) -> Column:
    """Running median, the ends reflected (edge values repeated)."""
    n, h = F.size(a), size // 2
    inside = lambda i: F.when(i < 0, -i - 1).when(i >= n, 2 * n - i - 1).otherwise(i)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.sort_array(F.transform(F.sequence(i - h, i + h), lambda j: F.get(a, F.least(F.greatest(inside(j), F.lit(0)), n - 1)))), F.lit(h)))


def _gradient(a: Column) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(a)
    low, high = lambda i: F.greatest(i - 1, F.lit(0)), lambda i: F.least(i + 1, n - 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.get(a, high(i)) - F.get(a, low(i))) / (high(i) - low(i)))


def should_stop(history: Column, mode: str = "mean", min_delta: float = 0.03, kernel: int = 5, strips: int = 5) -> Column:
    """ST9-ST14: whether a history (an array, oldest first) says stop. Null where the rule has nothing to compare."""
    last, rest = F.element_at(history, -1), F.slice(history, 1, F.size(history) - 1)
    if mode == "mean":
        return last > _let(rest, _mean)
    if mode == "robust_mean":
        ends = lambda r: F.struct(_quantile(r, 0.05).alias("low"), _quantile(r, 0.95).alias("high"))
        inner = lambda r: _let(ends(r), lambda e: F.filter(r, lambda x: (x > e["low"]) & (x < e["high"])))
        return last > _let(_let(rest, inner), _mean)
    if mode == "median":
        return last > _quantile(rest, 0.5)
    if mode == "generalisation_loss":
        return generalisation_loss(history) > 0.2
    if mode == "median_smoothing":
        share = lambda g: F.size(F.filter(g, lambda x: x < min_delta)) / F.size(g)
        return _let(rest, lambda r: _let(_median_filtered(r, kernel), lambda m: _let(_gradient(m), share))) < 0.5
    if mode == "validation_up":
        n = F.size(history)
        cut = F.slice(history, n % strips + 1, n)
        width = F.floor(n / strips).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.lit(strips - 1)), lambda k: generalisation_loss(F.slice(cut, k * width + 1, width)) >= min_delta)
        return F.when(width > 0, F.forall(parts, lambda x: F.coalesce(x, F.lit(False))))
    raise ValueError(f"unknown mode: {mode}")


def early_stops(rows: DataFrame, keys: list[str], order: list[str], loss: str, patience: int, modes: tuple[str, ...] = MODES) -> DataFrame:
    """ST9-ST15: stop_<mode> for every row whose history is full."""
    full = histories(rows, keys, order, loss, patience).where(F.size("history") == patience)
    return full.select(*rows.columns, *[should_stop(F.col("history"), m).alias(f"stop_{m}") for m in modes])
