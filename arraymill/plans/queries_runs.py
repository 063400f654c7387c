"""Queries over runs from a configuration, and over streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..operators import control as T
from ..operators import volume as V
from ..sources import files, images
from ..sources.shared import shared_dir
from ..streaming import pipeline as S
from . import runs as R
from .queries_volume import SHAPE, VOX, K, vox
from .queries_windows import _u
from .registry import query, table
from .spec import read_config

_REF = "((x + 2 * y + z + vec_id) % 3 = 0)"
_PAIR = f"{VOX}, j AS (SELECT vec_id, x, y, z, value > 0 AS s, {_REF} AS r FROM vox)"


def _sides(spark, d):
    v = vox(spark, d)
    inferred = v.withColumn("value", (F.col("value") > 0).cast("double"))
    reference = v.withColumn("value", ((F.col("x") + 2 * F.col("y") + F.col("z") + F.col("vec_id")) % 3 == 0).cast("double"))
    return inferred, reference


def _rounded(df, *names):
    return df.select(*[c if c not in names else F.round(c, 6).alias(c) for c in df.columns if c not in ("tp", "fp", "fn", "tn")])


@query(f"""WITH {_PAIR}, c AS (SELECT vec_id, count(*) FILTER (s AND r) AS tp, count(*) FILTER (s AND NOT r) AS fp, count(*) FILTER (r AND NOT s) AS fn FROM j GROUP BY 1)
SELECT vec_id, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS dice, round(tp / nullif(tp + fp + fn, 0), 6) AS jaccard FROM c""")
def run_evaluation_segmentation(spark, d):
    spec = read_config("[EVALUATION]\nevaluations = dice, jaccard\n[SEGMENTATION]\nevaluation_units = foreground")
    return _rounded(R.run_evaluation(spec, "segmentation", *_sides(spark, d), key="vec_id")["vec_id",], "dice", "jaccard")


_LABELS = f"""{_PAIR}, l AS (SELECT vec_id, label, s = (label = 1) AS s, r = (label = 1) AS r FROM j, (VALUES (0), (1)) t(label)),
c AS (SELECT vec_id, label, count(*) FILTER (s AND r) AS tp, count(*) FILTER (s AND NOT r) AS fp, count(*) FILTER (r AND NOT s) AS fn FROM l GROUP BY ALL),
m AS (SELECT vec_id, label::INT AS label, 2 * tp / nullif(2 * tp + fp + fn, 0) AS dice FROM c)"""
_BY_LABEL = "[EVALUATION]\nevaluations = dice\n[SEGMENTATION]\nevaluation_units = label\nnum_classes = 2"


@query(f"WITH {_LABELS} SELECT vec_id, label, round(dice, 6) AS dice FROM m")
def run_evaluation_labels(spark, d):
    return _rounded(R.run_evaluation(read_config(_BY_LABEL), "segmentation", *_sides(spark, d), key="vec_id")["vec_id", "label"], "dice")


@query(f"WITH {_LABELS} SELECT label, round(avg(dice), 6) AS mean_dice, round(stddev_pop(dice), 6) AS stdev_dice FROM m GROUP BY label")
def run_evaluation_rollup(spark, d):
    return _rounded(R.run_evaluation(read_config(_BY_LABEL), "segmentation", *_sides(spark, d), key="vec_id")["label",], "mean_dice", "stdev_dice")


@query(f"WITH {VOX}, j AS (SELECT vec_id, value AS o, 0.1 * x - 0.05 * y AS r FROM vox) SELECT vec_id, round(avg(pow(o - r, 2)), 6) AS mse, round(sqrt(avg(pow(o - r, 2))), 6) AS rmse, round(avg(abs(o - r)), 6) AS mae FROM j GROUP BY 1")
def run_evaluation_regression(spark, d):
    v = vox(spark, d)
    out = R.run_evaluation(read_config(""), "regression", v, v.withColumn("value", 0.1 * F.col("x") - 0.05 * F.col("y")), key="vec_id")["vec_id",]
    return _rounded(out, "mse", "rmse", "mae")


_CLASSES = """r AS (SELECT least(n_chars / 5000.0, 1.0)::DOUBLE AS p, quality = 1 AS y, quality FROM documents JOIN labels USING (doc_id)),
t AS (SELECT k::INT AS k, k / 9.0::DOUBLE AS threshold FROM range(10) x(k)),
c AS (SELECT k, threshold, count(*) FILTER (p > threshold AND y) AS tp, count(*) FILTER (p > threshold AND NOT y) AS fp, count(*) FILTER (p <= threshold AND NOT y) AS tn, count(*) FILTER (p <= threshold AND y) AS fn FROM r, t GROUP BY ALL)"""


def _classes(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", *[F.lit(0).alias(a) for a in "xyz"], F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)).alias("p"), F.col("quality").cast("double").alias("q"))
    side = lambda c: rows.select("doc_id", "x", "y", "z", F.col(c).alias("value"))
    return R.run_evaluation(read_config(""), "classification", side("p"), side("q"), key="doc_id")


@query(f"""WITH {_CLASSES}, s AS (SELECT k, 1 - tn/nullif(tn+fp,0) AS x, tp/nullif(tp+fn,0) AS y FROM c), l AS (SELECT (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM s WINDOW w AS (ORDER BY k DESC))
SELECT (SELECT round(avg(((p >= 0.5)::INT = quality)::INT::DOUBLE), 6) FROM r) AS accuracy, (SELECT round(sum(a), 6) FROM l) AS roc_auc""")
def run_evaluation_classification(spark, d):
    return _rounded(_classes(spark, d)[()], "accuracy", "roc_auc")


@query(f"WITH {_CLASSES} SELECT round(threshold, 6) AS threshold, round((tp+tn)/nullif(tp+fp+fn+tn,0),6) AS accuracy, round(tp/nullif(tp+fn,0),6) AS sensitivity, round(tn/nullif(tn+fp,0),6) AS specificity FROM c")
def run_evaluation_roc(spark, d):
    return _rounded(_classes(spark, d)["threshold",].drop("point"), "threshold", "accuracy", "sensitivity", "specificity")


@query(f"WITH {VOX} SELECT vec_id, x, y, z, round(2 * value + 1, 6) + 0 AS value FROM vox")
def run_inference(spark, d):
    """Padding, windows of 3 with border 1, a prediction that sees the place in its window (1 after the crop), reassembly."""
    spec = read_config("[NETWORK]\nvolume_padding_size = 1,1,1\nvolume_padding_mode = edge\n[INFERENCE]\nspatial_window_size = 3,3,3\nborder = 1,1,1")
    out = R.run_inference(spec, vox(spark, d), lambda cut: cut.withColumn("value", 2 * F.col("value") + F.col("x")), SHAPE, "vec_id")
    return out.select("vec_id", "x", "y", "z", F.round("value", 6).alias("value"))


@query(f"""WITH {VOX}, s AS (SELECT vec_id, draw::INT AS draw, ({_u('vec_id', 'draw', 0, 0)} % 3)::INT AS x0, ({_u('vec_id', 'draw', 1, 0)} % 3)::INT AS y0, ({_u('vec_id', 'draw', 2, 0)} % 3)::INT AS z0
FROM (SELECT vec_id, unnest(range(2)) AS draw FROM embeddings) r) SELECT vec_id, draw, x - x0 AS x, y - y0 AS y, z - z0 AS z, value FROM s JOIN vox USING (vec_id) WHERE x - x0 BETWEEN 0 AND 1 AND y - y0 BETWEEN 0 AND 1 AND z - z0 BETWEEN 0 AND 1""")
def run_training_windows(spark, d):
    spec = read_config("[NETWORK]\nwindow_sampling = uniform\n[TRAINING]\nsample_per_volume = 2")
    return R.run_training_windows(spec, vox(spark, d), (2, 2, 2), SHAPE, "vec_id").select(*K, "draw", "x", "y", "z", "value")


# volumes of four shapes and ranks, all of 64 voxels in C order: x, y, z, t, m by vec_id % 4
_SHAPES = [(4, 4, 4), (8, 4, 2), (4, 4, 2, 2), (2, 4, 4, 1, 2)]
_FIVE = f"""e AS (SELECT vec_id, embedding, [{", ".join(str([*s, 1, 1][:5]) for s in _SHAPES)}][vec_id % 4 + 1] AS s FROM embeddings),
p AS (SELECT vec_id, s, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS value FROM e),
vox AS (SELECT vec_id, (pos // (s[4] * s[5]) // s[3] // s[2] % s[1])::INT AS x, (pos // (s[4] * s[5]) // s[3] % s[2])::INT AS y, (pos // (s[4] * s[5]) % s[3])::INT AS z,
    (pos // s[5] % s[4])::INT AS t, (pos % s[5])::INT AS m, s, value FROM p)"""


def _shaped(spark, d):
    """Packed volumes (vec_id, shape, voxels) of the four shapes, of rank 3, 4 and 5."""
    shapes = F.array(*[F.array(*map(F.lit, s)) for s in _SHAPES])
    return table(spark, d, "embeddings").select("vec_id", F.get(shapes, (F.col("vec_id") % 4).cast("int")).alias("shape"), F.col("embedding").cast("array<float>").alias("voxels"))


@query(f"WITH {_FIVE} SELECT vec_id, x, y, z, t, m, round((2 * value + 1)::FLOAT, 4) + 0 AS value FROM vox")
def run_inference_files(spark, d):
    """Files in two folders, of three shapes and of rank 3 to 5, listed in a CSV; windows of 3 with border 1 over each volume,
    time point and modality; written as files again, and read back by the manifest's paths."""
    root = f"{shared_dir(spark)}/infer-{uuid.uuid4().hex}"
    unit = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    heads = _shaped(spark, d).select(F.concat(F.col("vec_id").cast("string"), F.lit(".nii")).alias("path"), "shape", unit.alias("affine"), F.array(*[F.lit(1.0)] * 3).alias("pixdim"), "voxels", "vec_id")
    listed = None
    for side in (0, 1):
        part = heads.where(F.floor(F.col("vec_id") / 4) % 2 == side)
        paths = images.write_files(images.nifti_bytes(part), f"{root}/in{side}").select(F.regexp_extract("name", "[0-9]+", 0).alias("subject_id"), "path")
        listed = paths if listed is None else listed.unionByName(paths)
    files.write_rows(listed, f"{root}/list.csv")
    spec = read_config(f"""[image]
csv_file = {root}/list.csv
[NETWORK]
volume_padding_size = 1,1,1
volume_padding_mode = edge
[INFERENCE]
spatial_window_size = 3,3,3
border = 1,1,1
save_seg_dir = {root}/out""")
    R.infer_files(spark, spec, lambda cut: cut.withColumn("value", 2 * F.col("value") + F.col("x")))
    manifest = read_config(f"[image]\ncsv_file = {root}/out/inferred.csv").sources["image"]
    out = R.load_source(spark, manifest, "image")
    return out.select(F.col("subject_id").cast("long").alias("vec_id"), "x", "y", "z", "t", "m", (F.round("value", 4) + 0).alias("value"))


_HALF = "(CASE WHEN g.{0} % 2 = 0 THEN (v.{0} = g.{0} // 2)::INT::DOUBLE ELSE 0.5 * (v.{0} = g.{0} // 2 OR v.{0} = g.{0} // 2 + 1)::INT END)"


@query(f"""WITH {_FIVE}, g AS (SELECT vec_id, t, m, unnest(range(2 * s[1] - 1)) AS x, y, z, s FROM (SELECT DISTINCT vec_id, t, m, s FROM vox), range(15) b(y), range(15) c(z) WHERE y < 2 * s[2] - 1 AND z < 2 * s[3] - 1),
w AS (SELECT g.vec_id, g.t, g.m, g.x, g.y, g.z, {_HALF.format("x")} * {_HALF.format("y")} * {_HALF.format("z")} AS w, value FROM g JOIN vox v USING (vec_id, t, m))
SELECT vec_id, t, m, x::INT AS x, y::INT AS y, z::INT AS z, round(sum(w * value), 6) + 0 AS value FROM w GROUP BY ALL""")
def vox_zoom_five_axes(spark, d):
    """RS2, RS4 by volume, time point and modality: each volume of its own shape on a grid twice as fine."""
    vox = R.voxel_table(_shaped(spark, d), "vec_id")
    keys, shape = V.sized(["vec_id", "t", "m"])
    out = V.zoom(vox, keys, shape, tuple(2 * n - 1 for n in shape), 1)
    return out.select("vec_id", "t", "m", *V.AXES, (F.round("value", 6) + 0).alias("value"))


_MIRROR = "(CASE WHEN (h.x - 2 + 2 * s[1]) % (2 * s[1]) < s[1] THEN (h.x - 2 + 2 * s[1]) % (2 * s[1]) ELSE 2 * s[1] - 1 - (h.x - 2 + 2 * s[1]) % (2 * s[1]) END)"


@query(f"""WITH {_FIVE}, a AS (SELECT DISTINCT vec_id, t, m, s, z FROM vox), g AS (SELECT vec_id, t, m, s, z, unnest(range(s[1] + 3)) AS x FROM a), h AS (SELECT vec_id, t, m, s, z, x, unnest(range(s[2] + 2)) AS y FROM g)
SELECT h.vec_id, h.t, h.m, h.x::INT AS x, h.y::INT AS y, h.z, value FROM (SELECT h.*, {_MIRROR} AS ix, (h.y - 1 + s[2]) % s[2] AS iy FROM h) h
JOIN vox v ON v.vec_id = h.vec_id AND v.t = h.t AND v.m = h.m AND v.z = h.z AND v.x = ix AND v.y = iy""")
def vox_pad_own_shapes(spark, d):
    """F-A1 by volume: x mirrored by two before and one behind, y wrapped by one, each volume of its own shape."""
    vox = R.voxel_table(_shaped(spark, d), "vec_id")
    keys, shape = V.sized(["vec_id", "t", "m"])
    grown = V.pad(V.pad(vox, keys, shape, (2, 0, 0), "symmetric", after=(1, 0, 0)), keys, shape, (0, 1, 0), "wrap")
    return grown.select("vec_id", "t", "m", *V.AXES, "value")


@query("""WITH i AS (SELECT unnest(range(1, 13)) AS iteration), s AS (SELECT iteration, 'training' AS phase FROM i UNION ALL SELECT iteration, 'validation' FROM i WHERE iteration % 3 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY iteration) - 1 AS k FROM s)
SELECT iteration, phase, n_nationkey, n_nationkey // 4 AS batch FROM k JOIN nation ON (phase = 'training' AND n_nationkey < 20 AND n_nationkey // 4 = k % 5) OR (phase = 'validation' AND n_nationkey < 12 AND n_nationkey // 4 = k % 3)""")
def step_sources(spark, d):
    """ST19: training steps take the batches of one source in turn, validation steps those of the other."""
    nation = table(spark, d, "nation").select("n_nationkey", F.floor(F.col("n_nationkey") / 4).alias("batch"))
    schedule = T.iterations(spark, 0, 12, 3, 1).select("iteration", "phase")
    return R.source_of_step(schedule, {"training": nation.where("n_nationkey < 20"), "validation": nation.where("n_nationkey < 12")}).select("iteration", "phase", "n_nationkey", "batch")


_STREAM = """r AS (SELECT c_nationkey AS k, c_custkey AS i, c_acctbal AS loss FROM customer),
h AS (SELECT k, count(*) AS n, list(loss ORDER BY i)[-8:] AS a FROM r GROUP BY k)"""


@query(f"WITH {_STREAM} SELECT k, least(n, 8)::INT AS n, CASE WHEN n >= 8 THEN a[8] > list_avg(a[1:7]) END AS stop_mean, CASE WHEN n >= 8 THEN (CASE WHEN list_min(a) = 0 THEN a[8] ELSE (a[8] - list_min(a)) / nullif(list_max(a) - list_min(a), 0) END) > 0.2 END AS stop_generalisation_loss FROM h")
def stream_stop_signals(spark, d):
    """ST8-ST15 on streams: two files a key's losses come in, history kept as state; the last update of each key."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("i"), F.col("c_acctbal").cast("double").alias("loss"))
    middle = rows.agg(((F.max("i") + F.min("i")) / 2).cast("long")).first()[0] or 0
    for part in (rows.where(F.col("i") <= middle), rows.where(F.col("i") > middle)):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    last = None
    for mode in ("mean", "generalisation_loss"):
        signals = S.stop_signals(S.source(spark, f"{root}/in", 1), "k", "i", "loss", 8, mode)
        done = signals.writeStream.outputMode("update").option("checkpointLocation", f"{root}/c-{mode}").trigger(availableNow=True)
        done.foreachBatch(lambda batch, n, mode=mode: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{root}/out-{mode}")).start().awaitTermination()
        out = spark.read.parquet(f"{root}/out-{mode}").groupBy("k").agg(F.max_by(F.struct("n", "stop"), "batch").alias("s")).select("k", F.col("s.n").alias("n"), F.col("s.stop").alias(f"stop_{mode}"))
        last = out if last is None else last.join(out.drop("n"), "k")
    return last
