"""Overlap, classification and regression metrics as grouped aggregates (AG1-AG22, AG30-AG40, AG70, AG73)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_c = F.col
_div = F.try_divide
_SENS, _SPEC = "try_divide(tp, fn + tp)", "try_divide(tn, tn + fp)"
_PPV, _NPV = "try_divide(tp, fp + tp)", "try_divide(tn, tn + fn)"

#: Metric name -> SQL expression over the counts tp, fp, fn, tn. A ratio with a zero denominator is null.
OVERLAP: dict[str, str] = {
    "n_pos_ref": "fn + tp",
    "n_neg_ref": "tn + fp",
    "n_pos_seg": "fp + tp",
    "n_neg_seg": "tn + fn",
    "n_intersection": "tp",
    "n_union": "fn + fp + tp",
    "specificity": _SPEC,
    "sensitivity": _SENS,
    "accuracy": "try_divide(tp + tn, tp + tn + fp + fn)",
    "false_positive_rate": "try_divide(fp, tn + fp)",
    "positive_predictive_values": _PPV,
    "negative_predictive_values": _NPV,
    "dice": "try_divide(2 * tp, 2 * tp + fp + fn)",
    "jaccard": "try_divide(tp, fn + fp + tp)",
    "informedness": f"{_SENS} + {_SPEC} - 1",
    "markedness": f"{_PPV} + {_NPV} - 1",
    "vol_ratio": "try_divide(tp + fp, fn + tp)",
    "vol_diff_rel": "try_divide(abs(fn - fp), fn + tp)",
}
ALIASES = {"Dice": "dice", "Jaccard": "jaccard", "intersection_over_union": "jaccard", "vol_diff": "vol_ratio"}


def binary(column: Column, label) -> Column:
    """PF10: 1 where the column equals the label, else 0; null stays null."""
    return (column == F.lit(label)).cast("int")


def is_binary(df: DataFrame, *columns: str) -> bool:
    """AG40: no value other than 0 and 1 (nulls apart) in the columns."""
    return df.where(reduce(lambda a, b: a | b, (~_c(x).isin(0, 1) for x in columns))).isEmpty()


def confusion(df: DataFrame, keys: list[str], seg: Column, ref: Column) -> DataFrame:
    """AG1, AG6-AG9: tp, fp, fn, tn of two boolean columns by key; rows with a null on either side count nowhere.

    One hash aggregate with map-side combine; an empty table gives no rows.
    """
    n = lambda cond, name: F.count_if(cond).cast("long").alias(name)
    return df.groupBy(*keys).agg(n(seg & ref, "tp"), n(seg & ~ref, "fp"), n(~seg & ref, "fn"), n(~seg & ~ref, "tn"))


def overlap_metrics(counts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """AG2-AG22: any of OVERLAP (or ALIASES) from the four counts, in one projection."""
    return counts.select("*", *[F.expr(OVERLAP[ALIASES.get(x, x)]).alias(x) for x in names or OVERLAP])


def roll_up(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """AG30: mean_<m> and (population) stdev_<m> over the subjects of each group; nulls are skipped."""
    return metrics.groupBy(*by).agg(*[f(x).alias(f"{p}_{x}") for x in names for p, f in (("mean", F.avg), ("stdev", F.stddev_pop))])


def accuracy(df: DataFrame, keys: list[str], predicted: Column, label: Column) -> DataFrame:
    """AG33: share of rows whose prediction equals the label."""
    return df.groupBy(*keys).agg(F.avg((predicted == label).cast("double")).alias("accuracy"))


def roc_table(df: DataFrame, keys: list[str], probability: Column, positive: Column, points: int = 10) -> DataFrame:
    """AG34: counts and rates at `points` thresholds from 0 to 1; one aggregate, the thresholds are a literal array."""
    cuts = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    rows = df.select(*keys, probability.cast("double").alias("__p"), positive.alias("__y"), F.posexplode(cuts).alias("point", "threshold"))
    over, y = _c("__p") > _c("threshold"), _c("__y")
    counts = rows.groupBy(*keys, "point", "threshold").agg(*[F.count_if(c).cast("long").alias(n) for n, c in (("tp", over & y), ("fp", over & ~y), ("fn", ~over & y), ("tn", ~over & ~y))])
    return counts.select(*keys, "point", "threshold", "tp", "fp", "fn", "tn", *[F.expr(OVERLAP[x]).alias(x) for x in ("accuracy", "sensitivity", "specificity")])


def roc_auc(df: DataFrame, keys: list[str], probability: Column, positive: Column, points: int = 10) -> DataFrame:
    """AG35: trapezoid area under the curve of roc_table, thresholds taken downwards."""
    table = roc_table(df, keys, probability, positive, points)
    w = Window.partitionBy(*keys).orderBy(F.desc("point"))
    x, y = 1 - _c("specificity"), _c("sensitivity")
    steps = table.select(*keys, ((x - F.lag(x).over(w)) * (y + F.lag(y).over(w)) / 2).alias("a"))
    return steps.groupBy(*keys).agg(F.sum("a").alias("auc"))


def regression(df: DataFrame, keys: list[str], out: Column, ref: Column) -> DataFrame:
    """AG36-AG39: mse, rmse, mae, r2 (on sums, with 1e-5 under the root)."""
    n = F.count(out - ref)
    cov, vo, vr = F.covar_pop(out, ref) * n, F.var_pop(out) * n, F.var_pop(ref) * n
    return df.groupBy(*keys).agg(
        F.avg(F.pow(out - ref, 2)).alias("mse"), F.sqrt(F.avg(F.pow(out - ref, 2))).alias("rmse"), F.avg(F.abs(out - ref)).alias("mae"),
        F.pow(cov / F.sqrt(vo * vr + 1e-5), 2).alias("r2"),
    )


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """AG70: rows (label, predicted, n) of a multi-class confusion matrix."""
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def centre_distance(df: DataFrame, keys: list[str], out: str, ref: str, axes: list[str], pixdim: tuple[float, ...] = (1.0, 1.0, 1.0)) -> DataFrame:
    """AG42: com_dist, the distance between the centres of mass of two weight columns, axes scaled by their voxel size.

    Both centres come from one aggregate; null where the weights of a side sum to zero.
    """
    centre = lambda w, a: _div(F.sum(_c(w).cast("double") * _c(a)), F.sum(_c(w).cast("double")))
    square = sum((F.pow((centre(out, a) - centre(ref, a)) * p, 2) for a, p in zip(axes, pixdim, strict=True)), F.lit(0.0))
    return df.groupBy(*keys).agg(F.sqrt(square).alias("com_dist"))


def centre_of_mass(df: DataFrame, keys: list[str], value: str, axes: list[str], pixdim: float = 1.0) -> DataFrame:
    """AG41: com_<axis> of a weight column, scaled by the voxel size; null where the weights sum to zero."""
    v = _c(value).cast("double")
    return df.groupBy(*keys).agg(*[(_div(F.sum(v * _c(a)), F.sum(v)) * pixdim).alias(f"com_{a}") for a in axes])
