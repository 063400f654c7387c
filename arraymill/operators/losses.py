"""Losses as weighted aggregates (LO1-LO31).

Segmentation losses act on class rows: subject keys, voxel keys, class c, probability p, one-hot truth o, weight w.
`class_rows` makes them from packed logits. Each loss is an aggregate by (subject, class), then by subject; `batch_mean`
takes the mean over subjects. Regression losses are one aggregate over columns.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intensity import argmax, softmax

_c = F.col
EPS = 1e-5
#: Distances between the five classes of the tree used by the Wasserstein loss.
TREE = (
    (0.0, 1.0, 1.0, 1.0, 1.0),
    (1.0, 0.0, 0.6, 0.2, 0.5),
    (1.0, 0.6, 0.0, 0.6, 0.7),
    (1.0, 0.2, 0.6, 0.0, 0.5),
    (1.0, 0.5, 0.7, 0.5, 0.0),
)


def class_rows(df: DataFrame, subject: list[str], logits: Column, truth: Column, weight: Column | None = None, normal: bool = True, voxel: list[str] = ()) -> DataFrame:
    """LO1: one row a voxel and class; absent classes are rows too, which is the spine that the means need."""
    p = softmax(logits) if normal else logits
    rows = df.select(*subject, *voxel, truth.alias("__g"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"), argmax(p).alias("top"), F.posexplode(p).alias("c", "p"))
    return rows.withColumn("o", (_c("c") == _c("__g")).cast("double")).drop("__g")


def dense_rows(df: DataFrame, subject: list[str], logits: Column, truth: Column, normal: bool = True) -> DataFrame:
    """LO3, LO6, LO7: class rows with soft truth (an array of probabilities)."""
    p = softmax(logits) if normal else logits
    pairs = F.posexplode(F.arrays_zip(p.alias("p"), truth.alias("o")))
    return df.select(*subject, F.lit(1.0).alias("w"), pairs.alias("c", "__s")).select(*subject, "w", "c", _c("__s")["p"].alias("p"), _c("__s")["o"].alias("o"))


def class_sums(rows: DataFrame, subject: list[str]) -> DataFrame:
    """All sums that the overlap losses need, by subject and class, in one aggregate."""
    w, p, o = _c("w"), _c("p"), _c("o")
    e = F.pow(o - p, 2)
    return rows.groupBy(*subject, "c").agg(
        F.sum(w * o * p).alias("op"), F.sum(w * p).alias("p"), F.sum(w * p * p).alias("pp"), F.sum(w * o).alias("o"), F.sum(w * o * o).alias("oo"), F.sum(e * o).alias("eo"), F.sum(e * (1 - o)).alias("en"),
        F.sum(1 - o).alias("n"), F.sum(w * (_c("top") == _c("c")).cast("double")).alias("hard") if "top" in rows.columns else F.lit(None).cast("double").alias("hard"),
    )


def batch_mean(losses: DataFrame, *names: str) -> DataFrame:
    """LO31: the mean over subjects."""
    return losses.agg(*[F.avg(n).alias(n) for n in names])


def dice_family(sums: DataFrame, subject: list[str]) -> DataFrame:
    """LO4-LO8, LO11, LO14, LO15 by subject, from class_sums.

    dice (squares), dice_ns, dice_dense, dice_dense_ns, tversky (0.5, 0.5), sens_spec (r 0.05), volume, volume_hard.
    """
    op, p, pp, o, oo = (_c(x) for x in ("op", "p", "pp", "o", "oo"))
    e = 0.001
    ratio = lambda a: F.abs((o + e) / (a + e) - (a + e) / (o + e))
    return sums.groupBy(*subject).agg(
        (1 - F.avg((2 * op + EPS) / (pp + o + EPS))).alias("dice"), (1 - F.avg((2 * op + EPS) / (p + o + EPS))).alias("dice_ns"),
        (1 - F.avg((2 * op + EPS) / (pp + oo + EPS))).alias("dice_dense"), (1 - F.avg((2 * op + EPS) / (p + o + EPS))).alias("dice_dense_ns"),
        (1 - F.sum(op) / (F.sum(op) + 0.5 * (F.sum(p) - F.sum(op)) + 0.5 * (F.sum(o) - F.sum(op)) + EPS)).alias("tversky"),
        F.sum(0.05 * _c("eo") / (o + EPS) + 0.95 * _c("en") / (_c("n") + EPS)).alias("sens_spec"), F.avg(ratio(p)).alias("volume"), F.avg(ratio(_c("hard"))).alias("volume_hard"),
    )


def tversky(sums: DataFrame, subject: list[str], alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """LO8."""
    tp, fp, fn = F.sum("op"), F.sum(_c("p") - _c("op")), F.sum(_c("o") - _c("op"))
    return sums.groupBy(*subject).agg((1 - tp / (tp + alpha * fp + beta * fn + EPS)).alias("tversky"))


def generalised_dice(sums: DataFrame, subject: list[str], kind: str = "square") -> DataFrame:
    """LO9: classes weighted by 1 / V^2, 1 / V or 1; an absent class takes the largest finite weight; an undefined score is 1."""
    v = _c("o")
    weight = {"square": F.try_divide(F.lit(1.0), v * v), "simple": F.try_divide(F.lit(1.0), v), "uniform": F.lit(1.0)}[kind]
    rows = sums.withColumn("__k", weight)
    top = rows.groupBy(*subject).agg(F.max("__k").alias("__m"))
    k = F.coalesce(_c("__k"), _c("__m"), F.lit(0.0))
    score = F.try_divide(2 * F.sum(k * _c("op")), F.sum(k * F.greatest(_c("p") + _c("o"), F.lit(1.0))))
    return rows.join(top, subject).groupBy(*subject).agg((1 - F.coalesce(score, F.lit(1.0))).alias("gdsc"))


def cross_entropy(df: DataFrame, subject: list[str], logits: Column, truth: Column, weight: Column | None = None) -> DataFrame:
    """LO2, LO24: the (weighted) mean of -log softmax at the true class, through a shifted log-sum-exp."""
    top = F.array_max(logits)
    e = top + F.log(F.aggregate(F.transform(logits, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v)) - F.get(logits, truth)
    if weight is None:
        return df.groupBy(*subject).agg(F.avg(e).alias("cross_entropy"))
    return df.groupBy(*subject).agg((F.sum(weight * e) / F.greatest(F.sum(weight), F.lit(1e-6))).alias("cross_entropy"))


def cross_entropy_dense(rows: DataFrame, subject: list[str], voxels: Column) -> DataFrame:
    """LO3: soft truth; voxels: the number of voxels of a subject, such as count(*) / classes."""
    return rows.groupBy(*subject).agg((-F.sum(_c("o") * F.log("p")) / voxels).alias("cross_entropy"))


def dice_plus_xent(family: DataFrame, xent: DataFrame, subject: list[str]) -> DataFrame:
    """LO10: cross entropy minus the plain Dice score, mean over the classes."""
    return family.join(xent, subject).select(*subject, (_c("cross_entropy") - (1 - _c("dice_ns"))).alias("dice_plus_xent"))


def undecided(rows: DataFrame, subject: list[str], voxel: list[str], classes: int) -> DataFrame:
    """LO16: the weighted mean over voxels of 1 / (mean_c |p - 1/C| + 1e-4)."""
    v = rows.groupBy(*subject, *voxel).agg((1 / (F.avg(F.abs(_c("p") - 1.0 / classes)) + 1e-4)).alias("u"), F.first("w").alias("w"))
    return v.groupBy(*subject).agg((F.sum(_c("u") * _c("w")) / F.sum("w")).alias("undecided"))


def wasserstein(rows: DataFrame, subject: list[str], voxel: list[str], classes: int, tree=TREE) -> DataFrame:
    """LO12, LO13: generalised Wasserstein Dice loss; delta is the disagreement of a voxel. Truth must be one-hot."""
    matrix = F.array(*[F.array(*[F.lit(x) for x in r]) for r in tree])
    v = rows.groupBy(*subject, *voxel).agg(F.max(F.when(_c("o") == 1, _c("c"))).alias("g"), F.array_sort(F.collect_list(F.struct("c", "p"))).alias("ps"))
    delta = F.aggregate("ps", F.lit(0.0), lambda s, x: s + x["p"] * F.get(F.get(matrix, x["c"]), _c("g")))
    v = v.withColumn("delta", delta).withColumn("tp", F.get(F.get(matrix, F.lit(0)), _c("g")) * (1 - _c("delta")))
    return v.groupBy(*subject).agg((1 - F.try_divide(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("delta"))).alias("wgdl"))


def regression_losses(df: DataFrame, subject: list[str], out: Column, ref: Column, weight: Column | None = None, delta: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """LO17-LO22: l1, l2, rmse, mae, huber, smooth_l1 by subject, in one aggregate."""
    r = F.abs(out - ref)
    w = weight if weight is not None else F.lit(1.0)
    l2 = F.sum(r * r) / 2 if weight is None else F.sum(r * r * w * w) / F.pow(F.sum(w), 2) / 2
    huber = F.when(r < delta, 0.5 * r * r).otherwise(delta * r - 0.5 * delta * delta)
    low = min(threshold, 1 / threshold)
    high = 1 / low
    first = F.when(r < low, low * r * r).otherwise(r + (low**3 - low))
    smooth = F.when(first > high, first * first + (high - high * high)).otherwise(first)
    mean = lambda x: F.try_divide(F.sum(w * x), F.sum(w))
    return df.groupBy(*subject).agg(mean(r).alias("l1"), l2.alias("l2"), F.sqrt(mean(r * r)).alias("rmse"), mean(r).alias("mae"), mean(huber).alias("huber"), mean(smooth).alias("smooth_l1"))


def cosine(df: DataFrame, subject: list[str], out: Column, ref: Column, weight: Column | None = None, complete: bool = True) -> DataFrame:
    """LO23: weighted mean of 1 - <p, g> of unit vectors, completed by sqrt(1 - min(sum x^2, 1)) on demand."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    full = lambda v: F.concat(v, F.array(F.sqrt(1 - F.least(total(v), F.lit(1.0))))) if complete else v
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(total(v)), F.lit(1e-5)))
    w = weight if weight is not None else F.lit(1.0)
    rows = df.select(*subject, full(out).alias("a"), full(ref).alias("b"), w.alias("w")).select(*subject, unit(_c("a")).alias("a"), unit(_c("b")).alias("b"), "w")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.groupBy(*subject).agg((F.sum((1 - dot) * _c("w")) / F.sum("w")).alias("cosine"))


def rater_confusion(df: DataFrame, truth: list[Column], predicted: list[Column], classes: int) -> DataFrame:
    """LO25: sum |C_truth - C_predicted| over pairs of raters and classes, by n and raters.

    truth: a class column a rater; predicted: an array of probabilities a rater. One aggregate over all items.
    """
    sums, n = [], len(truth)
    for i, j in combinations(range(n), 2):
        for a in range(classes):
            for b in range(classes):
                gt = ((truth[i] == a) & (truth[j] == b)).cast("double")
                sums.append(F.sum(gt) - F.sum(predicted[i][a] * predicted[j][b]))
    return df.agg((sum((F.abs(s) for s in sums), F.lit(0.0)) / F.count("*") / n).alias("rater_confusion"))


def variability(df: DataFrame, item: list[str], label: str) -> DataFrame:
    """LO26: 1 - sum of squared label frequencies of each item's ratings."""
    counts = df.groupBy(*item, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*item).agg((1 - F.sum(_c("n") * _c("n")) / F.pow(F.sum("n"), 2)).alias("variability"))


def variability_loss(truth: DataFrame, predicted: DataFrame, item: list[str], label: str, weight: DataFrame | None = None) -> DataFrame:
    """LO27: root of the mean squared difference of the items' sums of squared frequencies."""
    a, b = variability(truth, item, label).withColumnRenamed("variability", "a"), variability(predicted, item, label).withColumnRenamed("variability", "b")
    rows = a.join(b, item)
    w = F.lit(1.0)
    if weight is not None:
        rows, w = rows.join(weight, item), _c("weight")
    return rows.agg(F.sqrt(F.avg(w * F.pow(_c("a") - _c("b"), 2))).alias("variability_loss"))


def rmse_consistency(df: DataFrame, average: Column, raters: Column) -> DataFrame:
    """LO28: root mean square of the average prediction against the mean of the raters' (arrays of equal length)."""
    d = F.transform(F.sequence(F.lit(0), F.size(average) - 1), lambda k: F.pow(F.get(average, k) - F.aggregate(raters, F.lit(0.0), lambda s, r: s + F.get(r, k)) / F.size(raters), 2))
    total, n = F.sum(F.aggregate(d, F.lit(0.0), lambda s, x: s + x)), F.sum(F.size(d))
    return df.agg(F.sqrt(total / n).alias("rmse_consistency"))


def variational_bound(df: DataFrame, mean: Column, logvar: Column, data_mean: Column, data_logvar: Column, original: Column) -> DataFrame:
    """LO29: mean over items of the KL divergence minus the Gaussian log-likelihood (arrays a row)."""
    kl = F.aggregate(F.zip_with(mean, logvar, lambda m, v: 1 + v - m * m - F.exp(v)), F.lit(0.0), lambda s, x: s + x) * -0.5
    terms = F.zip_with(F.zip_with(data_mean, original, lambda a, b: F.pow(a - b, 2)), data_logvar, lambda d, v: v + 1.837877 + F.exp(-v) * d)
    like = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) * -0.5
    return df.agg(F.avg(kl - like).alias("variational_bound"))


def gan_entropy(df: DataFrame, logit: Column) -> DataFrame:
    """LO30: sigmoid cross entropy for the generator, fake and (softened by 0.1) real targets."""
    entropy = lambda t: F.avg(F.greatest(logit, F.lit(0.0)) - logit * t + F.log1p(F.exp(-F.abs(logit))))
    return df.agg(entropy(1.0).alias("g"), entropy(0.0).alias("d_fake"), entropy(0.9).alias("d_real"))
