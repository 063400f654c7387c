"""Queries over the overlap, classification and regression metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import confusion as M
from .registry import query, table

_RATIOS = {
    "specificity": "tn/nullif(tn+fp,0)", "sensitivity": "tp/nullif(fn+tp,0)", "accuracy": "(tp+tn)/nullif(tp+tn+fp+fn,0)",
    "false_positive_rate": "fp/nullif(tn+fp,0)", "positive_predictive_values": "tp/nullif(fp+tp,0)", "negative_predictive_values": "tn/nullif(tn+fn,0)",
    "dice": "2.0*tp/nullif(2*tp+fp+fn,0)", "jaccard": "tp/nullif(fn+fp+tp,0)", "informedness": "tp/nullif(fn+tp,0)+tn/nullif(tn+fp,0)-1",
    "markedness": "tp/nullif(fp+tp,0)+tn/nullif(tn+fn,0)-1", "vol_ratio": "(tp+fp)/nullif(fn+tp,0)", "vol_diff_rel": "abs(fn-fp)/nullif(fn+tp,0)",
}
_COUNTS = {"n_pos_ref": "fn+tp", "n_neg_ref": "tn+fp", "n_pos_seg": "fp+tp", "n_neg_seg": "tn+fn", "n_intersection": "tp", "n_union": "fn+fp+tp"}
_SELECT = ", ".join([f"{v} AS {k}" for k, v in _COUNTS.items()] + [f"round({v}, 6) AS {k}" for k, v in _RATIOS.items()])
_BASE = """
SELECT {key}, count(*) FILTER (toxic=1 AND quality=1) AS tp, count(*) FILTER (toxic=1 AND quality<>1) AS fp,
       count(*) FILTER (toxic<>1 AND quality=1) AS fn, count(*) FILTER (toxic<>1 AND quality<>1) AS tn
FROM documents JOIN labels USING (doc_id) GROUP BY {key}
"""


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")


def _overlap(spark, d, key):
    counts = M.confusion(_labelled(spark, d), [key], M.binary(F.col("toxic"), 1) == 1, M.binary(F.col("quality"), 1) == 1)
    out = M.overlap_metrics(counts)
    return out.select(key, "tp", "fp", "fn", "tn", *_COUNTS, *[F.round(x, 6).alias(x) for x in _RATIOS])


@query(f"SELECT source, tp, fp, fn, tn, {_SELECT} FROM ({_BASE.format(key='source')})")
def seg_overlap_by_source(spark, d):
    """Flagship: catalog join, binarised labels, confusion counts and every overlap metric by source."""
    return _overlap(spark, d, "source")


@query(f"SELECT lang, tp, fp, fn, tn, {_SELECT} FROM ({_BASE.format(key='lang')})")
def seg_metrics_by_lang(spark, d):
    return _overlap(spark, d, "lang")


@query(f"""
WITH m AS (SELECT lang, source, 2.0*tp/nullif(2*tp+fp+fn,0) AS dice, tp/nullif(fn+fp+tp,0) AS jaccard, (tp+tn)/nullif(tp+tn+fp+fn,0) AS accuracy
           FROM ({_BASE.format(key='lang, source')}))
SELECT lang, round(avg(dice),6) AS mean_dice, round(stddev_pop(dice),6) AS stdev_dice, round(avg(jaccard),6) AS mean_jaccard, round(stddev_pop(jaccard),6) AS stdev_jaccard,
       round(avg(accuracy),6) AS mean_accuracy, round(stddev_pop(accuracy),6) AS stdev_accuracy
FROM m GROUP BY lang""")
def seg_rollup_mean_std(spark, d):
    names = ["dice", "jaccard", "accuracy"]
    counts = M.confusion(_labelled(spark, d), ["lang", "source"], F.col("toxic") == 1, F.col("quality") == 1)
    out = M.roll_up(M.overlap_metrics(counts, names), ["lang"], names)
    return out.select("lang", *[F.round(c, 6).alias(c) for c in out.columns if c != "lang"])


@query("SELECT source, round(avg((toxic = quality)::INT::DOUBLE), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY source")
def cls_accuracy(spark, d):
    return M.accuracy(_labelled(spark, d), ["source"], F.col("toxic"), F.col("quality")).select("source", F.round("accuracy", 6).alias("accuracy"))


_ROC = """
r AS (SELECT lang, least(n_chars / 5000.0, 1.0)::DOUBLE AS p, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
t AS (SELECT k::INT AS k, k / 9.0::DOUBLE AS threshold FROM range(10) x(k)),
c AS (SELECT lang, k, threshold, count(*) FILTER (p > threshold AND y) AS tp, count(*) FILTER (p > threshold AND NOT y) AS fp,
             count(*) FILTER (p <= threshold AND NOT y) AS tn, count(*) FILTER (p <= threshold AND y) AS fn
      FROM r, t GROUP BY ALL)
"""


def _roc_input(spark, d):
    return _labelled(spark, d), ["lang"], F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)), F.col("quality") == 1


@query(f"""WITH {_ROC} SELECT lang, k AS point, round(threshold, 6) AS threshold, tp, fp, fn, tn, round((tp+tn)/nullif(tp+fp+fn+tn,0),6) AS accuracy,
round(tp/nullif(tp+fn,0),6) AS sensitivity, round(tn/nullif(tn+fp,0),6) AS specificity FROM c""")
def roc_table(spark, d):
    out = M.roc_table(*_roc_input(spark, d))
    return out.select("lang", "point", F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("accuracy", "sensitivity", "specificity")])


@query(f"""WITH {_ROC}, s AS (SELECT lang, k, 1 - tn/nullif(tn+fp,0) AS x, tp/nullif(tp+fn,0) AS y FROM c),
l AS (SELECT lang, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM s WINDOW w AS (PARTITION BY lang ORDER BY k DESC))
SELECT lang, round(sum(a), 6) AS auc FROM l GROUP BY lang""")
def roc_auc(spark, d):
    return M.roc_auc(*_roc_input(spark, d)).select("lang", F.round("auc", 6).alias("auc"))


@query("SELECT l_returnflag AS label, l_linestatus AS predicted, count(*) AS n FROM lineitem GROUP BY ALL")
def confusion_multi(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("predicted"))
    return M.confusion_matrix(rows, "label", "predicted")


_REG = "SELECT l_returnflag, l_quantity * p_retailprice AS o, l_extendedprice AS r, l_discount AS w FROM lineitem JOIN part ON l_partkey = p_partkey"


def regression_rows(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    rows = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_returnflag", (F.col("l_quantity") * F.col("p_retailprice")).alias("o"), F.col("l_extendedprice").alias("r"), F.col("l_discount").alias("w"))


@query(f"SELECT l_returnflag, round(avg(pow(o-r,2)),2) AS mse, round(sqrt(avg(pow(o-r,2))),4) AS rmse, round(avg(abs(o-r)),4) AS mae FROM ({_REG}) GROUP BY 1")
def reg_metrics(spark, d):
    out = M.regression(regression_rows(spark, d), ["l_returnflag"], F.col("o"), F.col("r"))
    return out.select("l_returnflag", F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query(f"SELECT l_returnflag, round(pow(covar_pop(o,r)*count(*)/sqrt(var_pop(o)*count(*)*var_pop(r)*count(*)+1e-5),2),6) AS r2 FROM ({_REG}) GROUP BY 1")
def reg_r2(spark, d):
    return M.regression(regression_rows(spark, d), ["l_returnflag"], F.col("o"), F.col("r")).select("l_returnflag", F.round("r2", 6).alias("r2"))
