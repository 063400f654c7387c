"""Grey-level co-occurrence and its features (AG60, AG61)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .surface import SHIFTS
from .volume import AXES

_c = F.col


def glcm(vox: DataFrame, keys: list[str], neighbours: int = 6, bins: int = 100, scale: float = 100.0) -> DataFrame:
    """AG60: (keys, shift, i, j, n, p): grey levels of each voxel and of its shifted neighbour; outside counts as 0.

    Levels are rint(v * scale) + 1, kept in [0, bins). p is normalised by shift. The shifts are a literal array, so
    voxels meet their neighbours in one equi-join.
    """
    level = F.least(F.greatest(F.rint(_c("value") * scale) + 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    none = min(bins - 1, 1)
    moved = F.array(*[F.struct(F.lit(k).alias("shift"), *[(_c(a) - d).alias(a) for a, d in zip(AXES, s, strict=True)]) for k, s in enumerate(SHIFTS[1 : neighbours + 1], 1)])
    left = vox.select(*keys, level.alias("i"), F.explode(moved).alias("k")).select(*keys, "i", "k.*")
    right = vox.select(*keys, *AXES, level.alias("j"))
    pairs = left.join(right, [*keys, *AXES], "left").withColumn("j", F.coalesce("j", F.lit(none)))
    counts = pairs.groupBy(*keys, "shift", "i", "j").agg(F.count("*").alias("n"))
    return counts.withColumn("p", _c("n") / F.sum("n").over(Window.partitionBy(*keys, "shift")))


def haralick(matrix: DataFrame, keys: list[str], bins: int = 100) -> DataFrame:
    """AG61: the features of every shift's matrix, averaged over the shifts.

    Entropies are sums of p ln p (no minus), as in AG61d and AG61g; homogeneity divides by 1 + |i - j|.
    """
    by = [*keys, "shift"]
    p, i, j = _c("p"), _c("i"), _c("j")
    plain = matrix.groupBy(*by).agg(
        F.sum(p * p).alias("asm"), F.sum(F.pow(j - i, 2) * p).alias("contrast"), F.sum(p / (1 + F.abs(i - j))).alias("homogeneity"), F.sum(p * F.log(p)).alias("entropy"),
        F.sum(p / (1 + F.pow(i - j, 2))).alias("idm"), F.sum((i + j) * p).alias("sum_average"), (F.sum(j * p) / (bins * bins)).alias("__mean"), F.sum(i * i * p).alias("__ii"), F.sum(i * p).alias("__i"), F.sum(p).alias("__p"),
    )
    plain = plain.withColumn("sum_square_variance", _c("__ii") - 2 * _c("__mean") * _c("__i") + F.pow("__mean", 2) * _c("__p"))
    sums = matrix.groupBy(*by, (i + j).alias("k")).agg(F.sum("p").alias("q"))
    sums = sums.groupBy(*by).agg(F.sum(_c("q") * F.log("q")).alias("sum_entropy"), F.sum(F.pow("k", 2) * _c("q")).alias("__kk"), F.sum(_c("k") * _c("q")).alias("__k"), F.sum("q").alias("__q"))
    sums = sums.withColumn("sum_variance", _c("__kk") - 2 * _c("sum_entropy") * _c("__k") + F.pow("sum_entropy", 2) * _c("__q"))
    gaps = matrix.groupBy(*by, F.abs(i - j).alias("k")).agg(F.sum("p").alias("q"))
    gaps = gaps.groupBy(*by).agg(F.sum(F.pow("k", 2) * _c("q")).alias("difference_variance"), (-F.sum(_c("q") * F.log("q"))).alias("difference_entropy"))
    column = matrix.groupBy(*by, _c("j").alias("c")).agg(F.sum("p").alias("s"))
    mean = _c("c") * _c("s")
    column = column.withColumn("mean", mean).withColumn("sd", F.abs(_c("c") - mean) * F.sqrt("s"))
    # pairs of levels of one matrix: at most bins * bins
    a = column.select(*by, _c("c").alias("i"), _c("s").alias("si"), _c("mean").alias("mi"), _c("sd").alias("di"))
    b = column.select(*by, _c("c").alias("j"), _c("s").alias("sj"), _c("mean").alias("mj"), _c("sd").alias("dj"))
    both = a.join(b, by).join(matrix.select(*by, "i", "j", "p"), [*by, "i", "j"], "left").na.fill(0.0, ["p"])
    product = _c("si") * _c("sj")
    pairs = both.groupBy(*by).agg(
        F.sum(F.when((_c("di") > 0) & (_c("dj") > 0), (i * j * p - _c("mi") * _c("mj")) / (_c("di") * _c("dj"))).otherwise(0.0)).alias("__both"),
        (-F.sum(product * F.log(product + 0.001))).alias("__h2"), (-F.sum(p * F.log(product + 0.001))).alias("__h1"),
    )
    # a row level with entries but no column entries has p > 0 and no marginal: its terms are the bare logarithm
    missing = matrix.join(column.select(*by, _c("c").alias("i")), [*by, "i"], "left_anti").groupBy(*by).agg((-F.sum("p") * F.log(F.lit(0.001))).alias("__h0"))
    rows = column.groupBy(*by).agg((-F.sum(_c("s") * F.log(_c("s") + 0.001))).alias("__hx"))
    out = plain.join(sums, by).join(gaps, by).join(pairs, by).join(rows, by).join(missing, by, "left")
    h1 = _c("__h1") + F.coalesce("__h0", F.lit(0.0))
    out = out.withColumn("correlation", _c("__both")).withColumn("imc1", F.try_divide(_c("entropy") - h1, _c("__hx")))
    inner = 1 - F.exp(-2 * (_c("__h2") - _c("entropy")))
    out = out.withColumn("imc2", F.when(_c("entropy") == 0, 0.0).otherwise(F.sqrt(F.greatest(inner, F.lit(0.0))))).withColumn("energy", _c("asm"))
    names = [
        "asm", "energy", "contrast", "homogeneity", "entropy", "correlation", "idm", "sum_average", "sum_entropy", "sum_variance", "difference_variance", "difference_entropy",
        "imc1", "imc2", "sum_square_variance",
    ]
    return out.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])
