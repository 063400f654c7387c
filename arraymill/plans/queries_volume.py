"""Queries over volumes: each embedding of 64 values is a volume of 4 x 4 x 4 voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intensity as I
from ..operators import volume as V
from .registry import query, table

K, SHAPE = ["vec_id"], (4, 4, 4)
VOX = """vox AS (SELECT vec_id, label, (pos // 16)::INT AS x, ((pos // 4) % 4)::INT AS y, (pos % 4)::INT AS z, v::DOUBLE AS value
FROM (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings))"""


def vox(spark, d, extra=()):
    return V.voxels(table(spark, d, "embeddings"), [*K, *extra], "embedding", SHAPE)


def rounded(df, digits=6):
    return df.select(*K, *V.AXES, F.round("value", digits).alias("value"))


@query(f"WITH {VOX} SELECT vec_id, x, y, z, value FROM vox")
def vox_explode(spark, d):
    return vox(spark, d)


@query("SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * (i + 1))), 6) AS checksum FROM embeddings")
def vox_pack_roundtrip(spark, d):
    back = V.packed(vox(spark, d), K)
    weighted = F.aggregate(F.transform("voxels", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return back.select("vec_id", F.round(weighted, 6).alias("checksum"))


@query(f"WITH {VOX} SELECT vec_id, x, y, z, 0 AS m, value FROM vox UNION ALL SELECT vec_id, x, y, z, 1, -value FROM vox")
def vox_stack_modalities(spark, d):
    a = vox(spark, d)
    return V.stack_modalities([a, a.withColumn("value", -F.col("value"))])


@query(f"""WITH {VOX}, g AS (SELECT vec_id, i::INT AS x, j::INT AS y, k::INT AS z FROM (SELECT DISTINCT vec_id FROM vox), range(8) a(i), range(6) b(j), range(4) c(k))
SELECT g.vec_id, g.x, g.y, g.z, coalesce(value, 1.5) AS value FROM g LEFT JOIN vox v ON g.vec_id = v.vec_id AND g.x = v.x + 2 AND g.y = v.y + 1 AND g.z = v.z""")
def vox_pad_constant(spark, d):
    return V.pad(vox(spark, d), K, SHAPE, (2, 1, 0), "constant", 1.5)


@query(f"""WITH {VOX}, g AS (SELECT vec_id, i::INT AS x, j::INT AS y, k::INT AS z FROM (SELECT DISTINCT vec_id FROM vox), range(8) a(i), range(6) b(j), range(4) c(k))
SELECT g.vec_id, g.x, g.y, g.z, value FROM g JOIN vox v ON g.vec_id = v.vec_id AND least(greatest(g.x - 2, 0), 3) = v.x AND least(greatest(g.y - 1, 0), 3) = v.y AND g.z = v.z""")
def vox_pad_edge(spark, d):
    return V.pad(vox(spark, d), K, SHAPE, (2, 1, 0), "edge")


@query(f"""WITH {VOX}, s AS (SELECT * FROM (VALUES (0,1),(1,0),(2,1),(3,2),(4,3),(5,2)) t(o, i)), w AS (SELECT * FROM (VALUES (0,0),(1,0),(2,1),(3,2),(4,3),(5,3)) t(o, i))
SELECT vec_id, s.o::INT AS x, w.o::INT AS y, z, value FROM vox JOIN s ON s.i = x JOIN w ON w.i = y""")
def vox_pad_reflect_symmetric(spark, d):
    return V.pad(V.pad(vox(spark, d), K, SHAPE, (1, 0, 0), "reflect"), K, (6, 4, 4), (0, 1, 0), "symmetric")


@query(f"""WITH {VOX}, a AS (SELECT vec_id, x + 1 AS x, y, z, value FROM vox UNION ALL SELECT vec_id, unnest([0, 5]), y, z, min(value) FROM vox GROUP BY vec_id, y, z)
SELECT vec_id, x, y + 1 AS y, z, value FROM a UNION ALL SELECT vec_id, x, unnest([0, 5]), z, min(value) FROM a GROUP BY vec_id, x, z""")
def vox_pad_minimum(spark, d):
    return V.pad(vox(spark, d), K, SHAPE, (1, 1, 0))


@query(f"WITH {VOX} SELECT vec_id, x - 1 AS x, y, z, value FROM vox WHERE x BETWEEN 1 AND 2")
def vox_unpad(spark, d):
    return V.unpad(vox(spark, d), SHAPE, (1, 2, 0))


@query(f"WITH {VOX} SELECT vec_id, x, y, z, value FROM vox")
def vox_pad_unpad_roundtrip(spark, d):
    return V.unpad(V.pad(vox(spark, d), K, SHAPE, (1, 2, 3), "wrap"), (6, 8, 10), (1, 2, 3))


@query(f"WITH {VOX} SELECT vec_id, 3 - x AS x, y, 3 - z AS z, value FROM vox")
def vox_flip(spark, d):
    return V.flip(vox(spark, d), SHAPE, (0, 2))


@query(f"WITH {VOX} SELECT vec_id, 3 - y AS x, z AS y, 3 - x AS z, value FROM vox")
def vox_reorient(spark, d):
    """From codes (R, A, S) to (P, S, L): the first target axis is the second source axis, reversed, and so on."""
    return V.reorient(vox(spark, d), SHAPE, "RAS", "PSL")


_VOX_INDEX_TRANSFORMS_SQL = f"WITH {VOX} SELECT vec_id, x, y, z, (4 - x)::INT AS fx, (4 - y)::INT AS fy, z AS fz, trunc(x::FLOAT * 2.5::FLOAT)::INT AS rx FROM vox"


@query(_VOX_INDEX_TRANSFORMS_SQL)
@query(_VOX_INDEX_TRANSFORMS_SQL, name="vox_index_transforms")
def vox_index_transforms_all(spark, d):
    """Of all voxels, also those whose resampled index has a fraction, which is cut off (F-A11)."""
    point = [F.col(a) for a in V.AXES]
    fx, fy, fz = V.reorient_index(point, SHAPE, "RAS", "LPS")
    rx = V.resample_index(point, (2.5, 1.0, 1.0), (1.0, 1.0, 1.0))[0]
    return vox(spark, d).select("vec_id", "x", "y", "z", fx.alias("fx"), fy.alias("fy"), fz.alias("fz"), rx.alias("rx"))


@query(f"WITH {VOX} SELECT a.vec_id, a.x, a.y - 1 AS y, a.z - 1 AS z, round(b.value - a.value, 6) AS value FROM vox a JOIN vox b ON a.vec_id = b.vec_id AND a.x + 2 = b.x AND a.y = b.y AND a.z = b.z WHERE a.y IN (1, 2) AND a.z IN (1, 2)")
def vox_gradient(spark, d):
    return rounded(V.gradient(vox(spark, d), K, SHAPE, 0))


@query(f"""WITH {VOX}, w AS (SELECT o, exp(-0.5 * pow(o / 0.5, 2)) / (1 + 2 * exp(-2.0) + 2 * exp(-8.0)) AS w FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS o)),
a AS (SELECT vec_id, x + o AS x, y, z, sum(value * w) AS value FROM vox, w WHERE x + o BETWEEN 0 AND 3 GROUP BY ALL),
b AS (SELECT vec_id, x, y + o AS y, z, sum(value * w) AS value FROM a, w WHERE y + o BETWEEN 0 AND 3 GROUP BY ALL)
SELECT vec_id, x, y, (z + o)::INT AS z, round(sum(value * w), 6) AS value FROM b, w WHERE z + o BETWEEN 0 AND 3 GROUP BY vec_id, x, y, z + o""")
def vox_smooth(spark, d):
    return rounded(V.smooth(vox(spark, d), K, 0.5))


def _pool(f):
    return f"""WITH {VOX}, o AS (SELECT unnest([0, 1]) AS o)
SELECT vec_id, a.o AS x, b.o AS y, c.o AS z, round({f}(value), 6) AS value FROM vox, o a, o b, o c
WHERE x BETWEEN 2 * a.o AND 2 * a.o + 2 AND y BETWEEN 2 * b.o AND 2 * b.o + 2 AND z BETWEEN 2 * c.o AND 2 * c.o + 2 GROUP BY vec_id, a.o, b.o, c.o"""


@query(_pool("max"))
def vox_pool_max(spark, d):
    return rounded(V.pool(vox(spark, d), K, SHAPE, "max"))


@query(_pool("avg"))
def vox_pool_avg(spark, d):
    return rounded(V.pool(vox(spark, d), K, SHAPE, "avg"))


@query(f"WITH {VOX} SELECT vec_id, x // 2 AS x, y // 2 AS y, z // 2 AS z, round(value, 6) AS value FROM vox WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0")
def vox_pool_strided(spark, d):
    return rounded(V.pool(vox(spark, d), K, SHAPE, "constant"))


_POINTS = "pts AS (SELECT vec_id, k::INT AS pid, 0.3 + 0.7 * k AS px, 3.2 - 0.8 * k AS py, 0.5 * k AS pz FROM embeddings, range(5) t(k))"


def points(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pid"))
    k = F.col("pid").cast("double")
    return rows.select("vec_id", "pid", (F.lit(0.3) + 0.7 * k).alias("px"), (F.lit(3.2) - 0.8 * k).alias("py"), (0.5 * k).alias("pz"))


def _resample(corners: str, weight: str, total: str = "sum(w * coalesce(value, 0))") -> str:
    return f"""WITH {VOX}, {_POINTS}, o AS (SELECT unnest({corners}) AS o),
c AS (SELECT vec_id, pid, least(greatest(floor(px) + a.o, 0), 3) AS x, least(greatest(floor(py) + b.o, 0), 3) AS y, least(greatest(floor(pz) + c.o, 0), 3) AS z, {weight} AS w FROM pts, o a, o b, o c)
SELECT vec_id, pid, round({total}, 6) AS value FROM c LEFT JOIN vox USING (vec_id, x, y, z) GROUP BY vec_id, pid"""


@query(_resample("[0, 1]", " * ".join(f"(CASE WHEN {o}.o = 1 THEN p{a} - floor(p{a}) ELSE 1 - (p{a} - floor(p{a})) END)" for o, a in zip("abc", "xyz", strict=True))))
def vox_resample_linear(spark, d):
    return V.resample_linear(vox(spark, d), points(spark, d), K, SHAPE).withColumn("value", F.round("value", 6))


@query(_resample("[0, 1]", "1.0 / (" + " + ".join(f"pow(p{a} - floor(p{a}) - {o}.o, 2)" for o, a in zip("abc", "xyz", strict=True)) + " + 1e-5)", "sum(w * value) / sum(w)"))
def vox_resample_idw(spark, d):
    return V.resample_idw(vox(spark, d), points(spark, d), K, SHAPE).withColumn("value", F.round("value", 6))


def _spline(o, a):
    r = f"(p{a} - floor(p{a}))"
    return f"(CASE {o}.o WHEN -1 THEN pow(1-{r},3)/6 WHEN 0 THEN (3*pow({r},3)-6*pow({r},2)+4)/6 WHEN 1 THEN (-3*pow({r},3)+3*pow({r},2)+3*{r}+1)/6 ELSE pow({r},3)/6 END)"


@query(_resample("[-1, 0, 1, 2]", " * ".join(_spline(o, a) for o, a in zip("abc", "xyz", strict=True))))
def vox_resample_bspline(spark, d):
    return V.resample_bspline(vox(spark, d), points(spark, d), K, SHAPE).withColumn("value", F.round("value", 6))


@query(f"""WITH {VOX}, {_POINTS}
SELECT p.vec_id, pid, round(value, 6) AS value FROM pts p JOIN vox v ON p.vec_id = v.vec_id AND least(greatest(round_even(px, 0), 0), 3) = x AND least(greatest(round_even(py, 0), 0), 3) = y AND least(greatest(round_even(pz, 0), 0), 3) = z""")
def vox_resample_nearest(spark, d):
    return V.resample_nearest(vox(spark, d), points(spark, d), K, SHAPE).withColumn("value", F.round("value", 6))


@query("""SELECT i::INT AS i, least(greatest(i, 0), 3)::INT AS replicate, (((i % 4) + 4) % 4)::INT AS circular, least(((i % 6) + 6) % 6, 6 - ((i % 6) + 6) % 6)::INT AS symmetric
FROM (SELECT o_orderkey % 30 - 15 AS i FROM orders)""")
def boundary_modes(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 30 - 15).cast("int").alias("i"))
    return rows.select("i", *[V.bounded(F.col("i"), 4, m).cast("int").alias(m) for m in ("replicate", "circular", "symmetric")])


@query(f"""WITH {VOX}, g AS (SELECT vec_id, x, y, z, (y + 0.5) AS px, (3.0 - x) AS py, (0.5 * z) AS pz FROM vox), o AS (SELECT unnest([0, 1]) AS o),
c AS (SELECT vec_id, x, y, z, least(greatest(floor(px) + a.o, 0), 3) AS u, least(greatest(floor(py) + b.o, 0), 3) AS v, least(greatest(floor(pz) + c.o, 0), 3) AS t,
 {" * ".join(f"(CASE WHEN {o}.o = 1 THEN p{a} - floor(p{a}) ELSE 1 - (p{a} - floor(p{a})) END)" for o, a in zip("abc", "xyz", strict=True))} AS w FROM g, o a, o b, o c)
SELECT c.vec_id, c.x, c.y, c.z, round(sum(w * value), 6) AS value FROM c JOIN vox s ON c.vec_id = s.vec_id AND u = s.x AND v = s.y AND t = s.z GROUP BY ALL""")
def vox_affine_warp(spark, d):
    return rounded(V.warped(vox(spark, d), K, SHAPE, [[0, 1, 0, 0.5], [-1, 0, 0, 3], [0, 0, 0.5, 0]]))


@query(f"""WITH {VOX}, n AS (SELECT unnest([0, 1, 2]) AS k) SELECT vec_id, a.k AS x, b.k AS y, c.k AS z, round(value, 6) AS value FROM n a, n b, n c, vox
WHERE x = round_even(a.k * 1.5, 0) AND y = round_even(b.k * 1.5, 0) AND z = round_even(c.k * 1.5, 0)""")
def vox_zoom_nearest(spark, d):
    return rounded(V.zoom(vox(spark, d), K, SHAPE, (3, 3, 3), 0))


@query(f"WITH {VOX} SELECT vec_id, x, y, z, round(value * exp(0.2 + 0.1 * (x / 3.0) - 0.3 * (x / 3.0) * (z / 3.0) + 0.05 * pow(y / 3.0, 3)), 6) AS value FROM vox")
def vox_bias_field(spark, d):
    return rounded(V.bias_field(vox(spark, d), SHAPE, {(0, 0, 0): 0.2, (1, 0, 0): 0.1, (1, 0, 1): -0.3, (0, 3, 0): 0.05}))


@query(f"WITH {VOX} SELECT vec_id, x, y, z, round(value + CASE WHEN x < 2 THEN value ELSE 0 END, 6) AS value FROM vox")
def vox_elementwise_sum(spark, d):
    a = vox(spark, d)
    return rounded(V.elementwise_sum(a, a.where("x < 2"), K))


# intensity statistics: l_returnflag is the modality, l_suppkey the subject

_P = ["0.01", "0.1", "0.2", "0.25", "0.3", "0.4", "0.5", "0.6", "0.7", "0.75", "0.8", "0.9", "0.99"]
_MARKS = f"marks AS (SELECT l_returnflag, l_suppkey, quantile_cont(l_extendedprice::DOUBLE, [{', '.join(_P)}]) AS m FROM lineitem GROUP BY ALL)"
_MAP = f"""{_MARKS}, maps AS (SELECT l_returnflag, k, avg(coalesce((v - m[1]) * 100 / nullif(m[13] - m[1], 0), 0)) AS v
FROM (SELECT l_returnflag, m, unnest(range(13)) AS k, unnest(m) AS v FROM marks) GROUP BY ALL)"""


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_suppkey", "l_extendedprice", "l_quantity")


@query(f"WITH {_MARKS} SELECT l_returnflag, l_suppkey, " + ", ".join(f"round(m[{i + 1}], 4) AS p{i}" for i in range(13)) + " FROM marks")
def hist_landmarks(spark, d):
    marks = I.landmarks(_lines(spark, d), ["l_returnflag", "l_suppkey"], "l_extendedprice")
    return marks.select("l_returnflag", "l_suppkey", *[F.round(F.col("landmarks")[i], 4).alias(f"p{i}") for i in range(13)])


@query(f"WITH {_MAP} SELECT l_returnflag, k::INT AS k, round(v, 6) AS v FROM maps")
def hist_mapping(spark, d):
    marks = I.landmarks(_lines(spark, d), ["l_returnflag", "l_suppkey"], "l_extendedprice")
    return I.averaged_mapping(marks, ["l_returnflag"]).select("l_returnflag", F.posexplode("mapping").alias("k", "v")).withColumn("v", F.round("v", 6))


@query(f"""WITH {_MAP}, q AS (SELECT l_returnflag, list(v ORDER BY k) AS b FROM maps GROUP BY 1),
j AS (SELECT l_returnflag, l_suppkey, l_extendedprice AS v, [m[1], m[4], m[7], m[10], m[13]] AS a, [b[1], b[4], b[7], b[10], b[13]] AS b FROM lineitem JOIN marks USING (l_returnflag, l_suppkey) JOIN q USING (l_returnflag)),
s AS (SELECT *, 1 + (v >= a[2])::INT + (v >= a[3])::INT + (v >= a[4])::INT AS i FROM j)
SELECT l_returnflag, l_suppkey, count(*) AS n, round(avg(b[i] + coalesce((b[i+1] - b[i]) / nullif(a[i+1] - a[i], 0), 0) * (v - a[i])), 4) AS mean FROM s GROUP BY ALL""")
def hist_transform(spark, d):
    lines = _lines(spark, d)
    marks = I.landmarks(lines, ["l_returnflag", "l_suppkey"], "l_extendedprice")
    out = I.standardised(lines, ["l_returnflag", "l_suppkey"], "l_extendedprice", marks, I.averaged_mapping(marks, ["l_returnflag"]), ["l_returnflag"], "quartile")
    return out.groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("standard"), 4).alias("mean"))


@query(f"WITH {VOX}, s AS (SELECT vec_id, avg(value) AS m, stddev_pop(value) AS s FROM vox WHERE value > 0 GROUP BY 1) SELECT vec_id, x, y, z, round((value - m) / greatest(s, 1e-5), 6) AS value FROM vox LEFT JOIN s USING (vec_id)")
def whiten(spark, d):
    return rounded(I.whitened(vox(spark, d), K, "value", F.col("value") > 0).drop("value").withColumnRenamed("white", "value"))


_OTSU = f"""{VOX}, e AS (SELECT vec_id, min(value) AS lo, (max(value) - min(value)) / 256 AS w FROM vox GROUP BY 1),
h AS (SELECT vec_id, lo, w, least(floor((value - lo) / w), 255)::INT AS bin, count(*) AS n FROM vox JOIN e USING (vec_id) GROUP BY ALL),
c AS (SELECT *, lo + (bin + 0.5) * w AS centre FROM h),
r AS (SELECT vec_id, bin, centre, sum(n) OVER b AS w1, sum(n * centre) OVER b AS s1, sum(n) OVER a AS wt, sum(n * centre) OVER a AS st FROM c WINDOW a AS (PARTITION BY vec_id), b AS (PARTITION BY vec_id ORDER BY bin)),
k AS (SELECT *, round(coalesce(w1 * (wt - w1) * pow(s1 / w1 - (st - s1) / nullif(wt - w1, 0), 2), 0), 6) AS score FROM r),
t AS (SELECT vec_id, centre AS threshold FROM k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, bin) = 1)"""


@query(f"WITH {_OTSU} SELECT vec_id, round(threshold, 6) AS threshold FROM t")
def otsu(spark, d):
    return I.otsu(vox(spark, d), K, "value").withColumn("threshold", F.round("threshold", 6))


@query(f"""WITH {_OTSU}, m AS (SELECT vec_id, avg(value) AS mean FROM vox GROUP BY 1)
SELECT vec_id, x, y, z, value > threshold AND value > mean AS mask_and, value > threshold OR value > mean AS mask_or FROM vox JOIN t USING (vec_id) JOIN m USING (vec_id)""")
def foreground_masks(spark, d):
    v = vox(spark, d)
    at = [*K, *V.AXES]
    both = I.foreground(v, K, "value", "otsu_plus").select(*at, "mask").unionByName(I.foreground(v, K, "value", "mean_plus").select(*at, "mask"))
    return I.fused(both, at, "and").withColumnRenamed("mask", "mask_and").join(I.fused(both, at, "or").withColumnRenamed("mask", "mask_or"), at)


@query("SELECT vec_id, label, " + ", ".join(f"(label = {i})::INT AS c{i}" for i in range(10)) + " FROM embeddings")
def one_hot(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", I.one_hot(F.col("label"), 10, "int").alias("h"))
    return rows.select("vec_id", "label", *[F.col("h")[i].alias(f"c{i}") for i in range(10)])


_REGION_STATS_SQL = """WITH s AS (SELECT l_returnflag, l_suppkey, l_quantity::DOUBLE AS v, l_discount AS w FROM lineitem),
m AS (SELECT l_returnflag, l_suppkey, avg(v) AS mean, stddev_pop(v) AS sd FROM s GROUP BY ALL)
SELECT l_returnflag, l_suppkey, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(sum(v*w)/nullif(sum(w),0), 6) AS weighted_mean,
 round(avg(pow((v - mean) / nullif(sd, 0), 3)), 6) AS skewness, round(avg(pow((v - mean) / nullif(sd, 0), 4)) - 3, 6) AS kurtosis, round(quantile_cont(v, 0.5), 6) AS median
FROM s JOIN m USING (l_returnflag, l_suppkey) GROUP BY ALL"""


@query(_REGION_STATS_SQL)
@query(_REGION_STATS_SQL, name="region_stats")
def region_stats_all(spark, d):
    """Of all groups; skewness and kurtosis of a group without spread are null."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_suppkey", "l_quantity", "l_discount")
    out = I.region_stats(rows, ["l_returnflag", "l_suppkey"], "l_quantity", F.col("l_discount"))
    return out.select("l_returnflag", "l_suppkey", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "weighted_mean", "skewness", "kurtosis", "median")])


def _mq(p):
    a = f"n * {p} + 0.4 + 0.2 * {p}"
    k = f"floor(greatest(least({a}, n - 1), 1))"
    return f"CASE WHEN n = 1 THEN NULL ELSE round((1 - greatest(least({a} - {k}, 1), 0)) * x[{k}::INT] + greatest(least({a} - {k}, 1), 0) * x[{k}::INT + 1], 6) END"


_REGION_MQUANTILES_SQL = f"""WITH s AS (SELECT l_returnflag, l_suppkey, list(l_extendedprice ORDER BY l_extendedprice) AS x, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_suppkey, CASE WHEN n = 1 THEN round(x[1], 6) ELSE {_mq(0.25)} END AS q25, CASE WHEN n = 1 THEN round(x[1], 6) ELSE {_mq(0.75)} END AS q75 FROM s"""


@query(_REGION_MQUANTILES_SQL)
@query(_REGION_MQUANTILES_SQL, name="region_mquantiles")
def region_mquantiles_all(spark, d):
    """Of all groups, those of one row included."""
    out = I.mquantiles(_lines(spark, d), ["l_returnflag", "l_suppkey"], "l_extendedprice")
    return out.select("l_returnflag", "l_suppkey", F.round("q25", 6).alias("q25"), F.round("q75", 6).alias("q75"))


_X = "(c_acctbal / 2000)"


@query(f"""SELECT c_custkey, round(greatest({_X}, 0), 6) AS relu, round(least(greatest({_X}, 0), 6), 6) AS relu6, round(CASE WHEN {_X} > 0 THEN {_X} ELSE exp({_X}) - 1 END, 6) AS elu,
 round(greatest({_X}, 0) + ln(1 + exp(-abs({_X}))), 6) AS softplus, round({_X} / (abs({_X}) + 1), 6) AS softsign, round(1 / (1 + exp(-{_X})), 6) AS sigmoid,
 round((exp(2 * {_X}) - 1) / (exp(2 * {_X}) + 1), 6) AS tanh, round(1.0507009873554805 * CASE WHEN {_X} > 0 THEN {_X} ELSE 1.6732632423543772 * (exp({_X}) - 1) END, 6) AS selu, round(0.51 * {_X} + 0.49 * abs({_X}), 6) AS leakyrelu FROM customer""")
def activations(spark, d):
    x = F.col("c_acctbal") / 2000
    names = ("relu", "relu6", "elu", "softplus", "softsign", "sigmoid", "tanh", "selu", "leakyrelu")
    return table(spark, d, "customer").select("c_custkey", *[F.round(I.activation(x, n), 6).alias(n) for n in names])


@query("""WITH r AS (SELECT vec_id, list_transform(embedding[1:5], lambda v: v::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, e, list_transform(e, lambda v: exp(v - list_max(e))) AS p FROM r)
SELECT vec_id, round(p[1] / list_sum(p), 6) AS p0, round(p[5] / list_sum(p), 6) AS p4, (list_position(e, list_max(e)) - 1)::INT AS label FROM s""")
def softmax_argmax(spark, d):
    e = F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", I.softmax(e).alias("p"), I.argmax(e).alias("label"))
    return rows.select("vec_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[4], 6).alias("p4"), "label")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * 0.3 + l_extendedprice * 0.7, 4) AS mixed, round(pow(l_quantity - l_extendedprice, 2), 2) AS squared, round(abs(l_quantity - l_extendedprice), 4) AS absolute,
round(0.01 * pow(0.5, floor(l_linenumber / 3)), 8) AS rate FROM lineitem""")
def elementwise_maps(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(I.mixup(q, p, 0.3), 4).alias("mixed"), F.round(I.error_map(q, p), 2).alias("squared"), F.round(I.error_map(q, p, False), 4).alias("absolute"),
        F.round(I.decayed_rate(F.col("l_linenumber"), 0.01), 8).alias("rate"),
    )


@query(f"""WITH s AS (SELECT p_brand, p_partkey, round_even(0.299 * (p_size % 256) + 0.587 * ((p_partkey * 7) % 256) + 0.114 * ((p_partkey * 13) % 256), 0)::INT AS y FROM part),
h AS (SELECT p_brand, y, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT p_brand, y, n, sum(n) OVER (PARTITION BY p_brand ORDER BY y) AS c FROM h),
t AS (SELECT *, min(c) OVER (PARTITION BY p_brand) AS c0, sum(n) OVER (PARTITION BY p_brand) AS a FROM c)
SELECT p_brand, p_partkey, y, coalesce(round_even((c - c0) * 255.0 / nullif(a - c0, 0), 0), 0)::INT AS y_equal FROM s JOIN t USING (p_brand, y)""")
def rgb_equalisation(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") % 256).alias("r"), (k * 7 % 256).alias("g"), (k * 13 % 256).alias("b"))
    return I.equalised_luma(rows, ["p_brand"]).select("p_brand", "p_partkey", "y", "y_equal")
