"""Queries over losses, iterations and early stopping.

Every class label of the embeddings is a subject and each of its vectors a voxel: values 1-4 are logits of four
classes, the largest of values 5-8 is the true class, and 1 + vec_id % 3 the weight.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control as C
from ..operators import intensity as I
from ..operators import losses as L
from .queries_metrics import regression_rows
from .registry import query, table

_V = """v AS (SELECT label, vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS lg, list_transform(embedding[5:8], lambda x: x::DOUBLE) AS tr, 1.0 + vec_id % 3 AS w FROM embeddings),
e AS (SELECT label, vec_id, lg, (list_position(tr, list_max(tr)) - 1)::INT AS g, w, list_transform(lg, lambda x: exp(x - list_max(lg))) AS ex FROM v),
s AS (SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS ps FROM e),
r AS (SELECT label, vec_id, w, g, c::INT AS c, ps[c + 1] AS p, (c = g)::INT::DOUBLE AS o, (c = list_position(ps, list_max(ps)) - 1)::INT::DOUBLE AS h FROM s, range(4) t(c)),
q AS (SELECT label, c, sum(w*o*p) AS op, sum(w*p) AS p, sum(w*p*p) AS pp, sum(w*o) AS o, sum(pow(o-p,2)*o) AS eo, sum(pow(o-p,2)*(1-o)) AS en, sum(1-o) AS n, sum(w*h) AS h FROM r GROUP BY ALL)"""


def _packed(spark, d):
    cast = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("label", "vec_id", cast(1, 4).alias("lg"), I.argmax(cast(5, 4)).alias("g"), (F.lit(1.0) + F.col("vec_id") % 3).alias("w"))
    return rows


def _rows(spark, d):
    return L.class_rows(_packed(spark, d), ["label"], F.col("lg"), F.col("g"), F.col("w"), voxel=["vec_id"])


def _r6(df, *names):
    return df.select("label", *[F.round(n, 6).alias(n) for n in names])


@query(f"""WITH {_V} SELECT label, round(1 - avg((2*op+1e-5)/(pp+o+1e-5)), 6) AS dice, round(1 - avg((2*op+1e-5)/(p+o+1e-5)), 6) AS dice_ns, round(1 - sum(op)/(sum(op)+0.5*(sum(p)-sum(op))+0.5*(sum(o)-sum(op))+1e-5), 6) AS tversky,
round(sum(0.05*eo/(o+1e-5)+0.95*en/(n+1e-5)), 6) AS sens_spec, round(avg(abs((o+.001)/(p+.001)-(p+.001)/(o+.001))), 6) AS volume, round(avg(abs((o+.001)/(h+.001)-(h+.001)/(o+.001))), 6) AS volume_hard FROM q GROUP BY label""")
def loss_dice_family(spark, d):
    return _r6(L.dice_family(L.class_sums(_rows(spark, d), ["label"]), ["label"]), "dice", "dice_ns", "tversky", "sens_spec", "volume", "volume_hard")


@query(f"WITH {_V} SELECT label, round(1 - sum(op)/(sum(op)+0.3*sum(p-op)+0.7*sum(o-op)+1e-5), 6) AS tversky FROM q GROUP BY label")
def loss_tversky(spark, d):
    return _r6(L.tversky(L.class_sums(_rows(spark, d), ["label"]), ["label"], 0.3, 0.7), "tversky")


@query(f"""WITH {_V}, k AS (SELECT *, 1/nullif(o*o,0) AS k2, 1/nullif(o,0) AS k1 FROM q), m AS (SELECT *, coalesce(k2, max(k2) OVER (PARTITION BY label)) AS a, coalesce(k1, max(k1) OVER (PARTITION BY label)) AS b FROM k)
SELECT label, round(1 - 2*sum(a*op)/sum(a*greatest(p+o,1)), 6) AS square, round(1 - 2*sum(b*op)/sum(b*greatest(p+o,1)), 6) AS simple, round(1 - 2*sum(op)/sum(greatest(p+o,1)), 6) AS uniform FROM m GROUP BY label""")
def loss_gdsc(spark, d):
    sums = L.class_sums(_rows(spark, d), ["label"])
    out = None
    for kind in ("square", "simple", "uniform"):
        one = L.generalised_dice(sums, ["label"], kind).withColumnRenamed("gdsc", kind)
        out = one if out is None else out.join(one, "label")
    return _r6(out, "square", "simple", "uniform")


@query(f"""WITH {_V}, x AS (SELECT label, w, list_max(lg) + ln(list_sum(ex)) - lg[g + 1] AS e FROM s), f AS (SELECT label, avg((2*op+1e-5)/(p+o+1e-5)) AS d FROM q GROUP BY label)
SELECT label, round(avg(e), 6) AS cross_entropy, round(sum(w*e)/greatest(sum(w),1e-6), 6) AS weighted, round(sum(w*e)/greatest(sum(w),1e-6) - any_value(d), 6) AS dice_plus_xent FROM x JOIN f USING (label) GROUP BY label""")
def loss_xent(spark, d):
    p = _packed(spark, d)
    plain = L.cross_entropy(p, ["label"], F.col("lg"), F.col("g"))
    weighted = L.cross_entropy(p, ["label"], F.col("lg"), F.col("g"), F.col("w"))
    both = L.dice_plus_xent(L.dice_family(L.class_sums(_rows(spark, d), ["label"]), ["label"]), weighted, ["label"])
    return _r6(plain.join(weighted.withColumnRenamed("cross_entropy", "weighted"), "label").join(both, "label"), "cross_entropy", "weighted", "dice_plus_xent")


_SOFT = f"""{_V}, z AS (SELECT vec_id, list_transform(tr, lambda x: exp(x - list_max(tr))) AS ez FROM v), d AS (SELECT r.label, r.vec_id, r.c, r.p, ez[r.c + 1] / list_sum(ez) AS o FROM r JOIN z USING (vec_id)),
dq AS (SELECT label, c, sum(o*p) AS op, sum(p) AS p, sum(p*p) AS pp, sum(o) AS o, sum(o*o) AS oo FROM d GROUP BY ALL)"""


@query(f"""WITH {_SOFT}, x AS (SELECT label, -sum(o*ln(p)) / (count(*) / 4) AS e FROM d GROUP BY label)
SELECT label, round(1 - avg((2*op+1e-5)/(pp+oo+1e-5)), 6) AS dice_dense, round(1 - avg((2*op+1e-5)/(p+o+1e-5)), 6) AS dice_dense_ns, round(any_value(e), 6) AS cross_entropy FROM dq JOIN x USING (label) GROUP BY label""")
def loss_dense(spark, d):
    cast = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: x.cast("double"))
    rows = L.dense_rows(table(spark, d, "embeddings").select("label", cast(1, 4).alias("lg"), I.softmax(cast(5, 4)).alias("t")), ["label"], F.col("lg"), F.col("t"))
    out = L.dice_family(L.class_sums(rows, ["label"]), ["label"]).join(L.cross_entropy_dense(rows, ["label"], F.count("*") / 4), "label")
    return _r6(out, "dice_dense", "dice_dense_ns", "cross_entropy")


@query(f"""WITH {_V}, u AS (SELECT label, vec_id, any_value(w) AS w, 1/(avg(abs(p-0.25))+1e-4) AS u FROM r GROUP BY ALL) SELECT label, round(sum(u*w)/sum(w), 5) AS undecided FROM u GROUP BY label""")
def loss_undecided(spark, d):
    return L.undecided(_rows(spark, d), ["label"], ["vec_id"], 4).select("label", F.round("undecided", 5).alias("undecided"))


_TREE = ", ".join(f"({i}, {j}, {x})" for i, row in enumerate(L.TREE) for j, x in enumerate(row))


@query(f"""WITH {_V}, m AS (SELECT * FROM (VALUES {_TREE}) t(i, j, d)), x AS (SELECT label, vec_id, g, sum(p * d) AS delta FROM r JOIN m ON i = c AND j = g GROUP BY ALL),
t AS (SELECT x.*, d * (1 - delta) AS tp FROM x JOIN m ON i = 0 AND j = g) SELECT label, round(1 - 2*sum(tp)/(2*sum(tp)+sum(delta)), 6) AS wgdl FROM t GROUP BY label""")
def loss_wgdl(spark, d):
    return _r6(L.wasserstein(_rows(spark, d), ["label"], ["vec_id"], 4), "wgdl")


_REG = "SELECT l_returnflag, abs(l_quantity * p_retailprice - l_extendedprice) / 10000 AS a, l_discount AS w FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(f"""WITH x AS ({_REG}), y AS (SELECT *, CASE WHEN a < 0.5 THEN 0.5*a*a ELSE a + (0.125 - 0.5) END AS f FROM x)
SELECT l_returnflag, round(sum(w*a)/sum(w),6) AS l1, round(sum(a*a*w*w)/pow(sum(w),2)/2,9) AS l2, round(sqrt(sum(w*a*a)/sum(w)),6) AS rmse, round(sum(w*a)/sum(w),6) AS mae,
round(sum(w*CASE WHEN a<1 THEN 0.5*a*a ELSE a-0.5 END)/sum(w),6) AS huber, round(sum(w*CASE WHEN f>2 THEN f*f+(2-4) ELSE f END)/sum(w),6) AS smooth_l1 FROM y GROUP BY 1""")
def reg_losses(spark, d):
    rows = regression_rows(spark, d)
    out = L.regression_losses(rows, ["l_returnflag"], F.col("o") / 10000, F.col("r") / 10000, F.col("w"))
    return out.select("l_returnflag", *[F.round(c, 9 if c == "l2" else 6).alias(c) for c in out.columns[1:]])


@query("""WITH a AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS a, list_transform(embedding[9:16], lambda x: x::DOUBLE) AS b FROM embeddings),
f AS (SELECT vec_id, label, list_append(a, sqrt(1 - least(list_sum(list_transform(a, lambda x: x*x)), 1))) AS a, list_append(b, sqrt(1 - least(list_sum(list_transform(b, lambda x: x*x)), 1))) AS b FROM a),
c AS (SELECT label, 1 + vec_id % 3 AS w, 1 - list_dot_product(a, b) / (greatest(sqrt(list_dot_product(a, a)), 1e-5) * greatest(sqrt(list_dot_product(b, b)), 1e-5)) AS l FROM f)
SELECT label, round(sum(l*w)/sum(w), 6) AS cosine FROM c GROUP BY label""")
def loss_cosine(spark, d):
    cast = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("label", cast(1, 8).alias("a"), cast(9, 8).alias("b"), (1 + F.col("vec_id") % 3).cast("double").alias("w"))
    return _r6(L.cosine(rows, ["label"], F.col("a"), F.col("b"), F.col("w")), "cosine")


_RATE = "v AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: exp(x::DOUBLE)) AS e FROM embeddings), t AS (SELECT vec_id, (vec_id % 2)::INT AS t0, ((vec_id // 2) % 2)::INT AS t1, ((vec_id // 3) % 2)::INT AS t2, e FROM v)"


def _pairs():
    out = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        for a in (0, 1):
            for b in (0, 1):
                p = f"(e[{2*i+1+a}]/(e[{2*i+1}]+e[{2*i+2}]))*(e[{2*j+1+b}]/(e[{2*j+1}]+e[{2*j+2}]))"
                out.append(f"abs(sum((t{i}={a} AND t{j}={b})::INT) - sum({p}))")
    return " + ".join(out)


@query(f"WITH {_RATE} SELECT round(({_pairs()}) / count(*) / 3, 6) AS rater_confusion FROM t")
def rater_confusion(spark, d):
    k = F.col("vec_id")
    p = lambda a: I.softmax(F.transform(F.slice("embedding", a, 2), lambda x: x.cast("double")))
    rows = table(spark, d, "embeddings").select(*[x.cast("int").alias(f"t{i}") for i, x in enumerate((k % 2, F.floor(k / 2) % 2, F.floor(k / 3) % 2))], p(1).alias("p0"), p(3).alias("p1"), p(5).alias("p2"))
    out = L.rater_confusion(rows, [F.col(f"t{i}") for i in range(3)], [F.col(f"p{i}") for i in range(3)], 2)
    return out.select(F.round("rater_confusion", 6).alias("rater_confusion"))


@query("SELECT l_orderkey, round(1 - sum(n*n) / pow(sum(n), 2), 6) AS variability FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def rater_variability(spark, d):
    return L.variability(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag").select("l_orderkey", F.round("variability", 6).alias("variability"))


@query("""WITH a AS (SELECT l_orderkey, 1 - sum(n*n) / pow(sum(n), 2) AS v FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1),
b AS (SELECT l_orderkey, 1 - sum(n*n) / pow(sum(n), 2) AS v FROM (SELECT l_orderkey, CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'N' END AS f, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1)
SELECT round(sqrt(avg(pow(a.v - b.v, 2))), 6) AS variability_loss FROM a JOIN b USING (l_orderkey)""")
def rater_variability_loss(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    other = rows.select("l_orderkey", F.when(F.col("l_linestatus") == "O", "A").otherwise("N").alias("l_returnflag"))
    return L.variability_loss(rows, other, ["l_orderkey"], "l_returnflag").select(F.round("variability_loss", 6).alias("variability_loss"))


@query("""WITH x AS (SELECT list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)
SELECT round(sqrt(avg(pow(e[k] - (e[k+4] + e[k+8]) / 2, 2))), 6) AS rmse_consistency FROM (SELECT e, unnest([1,2,3,4]) AS k FROM x)""")
def rater_consistency(spark, d):
    e = lambda a: F.transform(F.slice("embedding", a, 4), lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select(e(1).alias("m"), F.array(e(5), e(9)).alias("r"))
    return L.rmse_consistency(rows, F.col("m"), F.col("r")).select(F.round("rmse_consistency", 6).alias("rmse_consistency"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
k AS (SELECT vec_id, -0.5 * sum(1 + e[i+4] - e[i]*e[i] - exp(e[i+4])) AS kl, -0.5 * sum(e[i+12] + 1.837877 + exp(-e[i+12]) * pow(e[i+8] - e[i+16], 2)) AS ll FROM (SELECT vec_id, e, unnest([1,2,3,4]) AS i FROM x) GROUP BY vec_id)
SELECT round(avg(kl - ll), 6) AS variational_bound FROM k""")
def loss_variational(spark, d):
    e = lambda a: F.transform(F.slice("embedding", a, 4), lambda x: x.cast("double"))
    return L.variational_bound(table(spark, d, "embeddings"), e(1), e(5), e(9), e(13), e(17)).select(F.round("variational_bound", 6).alias("variational_bound"))


@query("""WITH x AS (SELECT c_acctbal / 2000 AS x FROM customer), b AS (SELECT x, greatest(x, 0) + ln(1 + exp(-abs(x))) AS s FROM x)
SELECT round(avg(s - x), 6) AS g, round(avg(s), 6) AS d_fake, round(avg(s - 0.9 * x), 6) AS d_real FROM b""")
def loss_gan(spark, d):
    out = L.gan_entropy(table(spark, d, "customer"), F.col("c_acctbal") / 2000)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_H = "h AS (SELECT event_id, user_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h FROM events WHERE value IS NOT NULL)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "value").where("value is not null")


@query(f"WITH {_H} SELECT event_id, len(h)::INT AS n, round(list_sum(h), 6) AS total FROM h")
def loss_history(spark, d):
    rows = C.histories(_events(spark, d), ["user_id"], ["event_id"], "value", 10)
    return rows.select("event_id", F.size("history").alias("n"), F.round(F.aggregate("history", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"""WITH {_H}, f AS (SELECT event_id, h, h[1:9] AS r, h[10] AS last FROM h WHERE len(h) = 10),
q AS (SELECT *, list_aggregate(r, 'quantile_cont', 0.05) AS lo, list_aggregate(r, 'quantile_cont', 0.95) AS hi FROM f)
SELECT event_id, last > list_avg(r) AS stop_mean, last > list_avg(list_filter(r, lambda x: x > lo AND x < hi)) AS stop_robust_mean, last > list_median(r) AS stop_median,
CASE WHEN list_min(h) = 0 THEN last ELSE (last - list_min(h)) / nullif(list_max(h) - list_min(h), 0) END > 0.2 AS stop_generalisation_loss FROM q""")
def early_stop_modes(spark, d):
    modes = ("mean", "robust_mean", "median", "generalisation_loss")
    return C.early_stops(_events(spark, d), ["user_id"], ["event_id"], "value", 10, modes).select("event_id", *[f"stop_{m}" for m in modes])


@query(f"""WITH {_H}, f AS (SELECT event_id, h, h[1:9] AS r FROM h WHERE len(h) = 10),
m AS (SELECT event_id, list_transform(range(9), lambda i: list_median(list_transform(range(-2, 3), lambda j: r[1 + CASE WHEN i + j < 0 THEN -(i + j) - 1 WHEN i + j > 8 THEN 17 - (i + j) ELSE i + j END]))) AS s, h FROM f),
g AS (SELECT event_id, h, list_transform(range(9), lambda i: (s[least(i + 1, 8) + 1] - s[greatest(i - 1, 0) + 1]) / (least(i + 1, 8) - greatest(i - 1, 0))) AS g FROM m),
v AS (SELECT event_id, h, g, list_transform(range(5), lambda k: CASE WHEN least(h[2*k+1], h[2*k+2]) = 0 THEN h[2*k+2] ELSE coalesce((h[2*k+2] - least(h[2*k+1], h[2*k+2])) / nullif(greatest(h[2*k+1], h[2*k+2]) - least(h[2*k+1], h[2*k+2]), 0), -1) END >= 0.03) AS u FROM g)
SELECT event_id, len(list_filter(g, lambda x: x < 0.03)) / 9.0 < 0.5 AS stop_median_smoothing, list_bool_and(u) AS stop_validation_up FROM v""")
def early_stop_smoothed(spark, d):
    modes = ("median_smoothing", "validation_up")
    return C.early_stops(_events(spark, d), ["user_id"], ["event_id"], "value", 10, modes).select("event_id", *[f"stop_{m}" for m in modes])
