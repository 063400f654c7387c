"""Queries that go through files: sections, partitions, features, models, sinks and encoded volumes, written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import confusion as M
from ..operators import volume as V
from ..operators import windows as W
from ..sources import files, images
from ..sources.shared import shared_dir
from . import runs as R
from .queries_catalog import _SPLIT
from .queries_volume import SHAPE, VOX, K, rounded, vox
from .registry import query, table


def scratch(spark, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _subjects(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("subject_id"), "source", "lang")


@query("SELECT doc_id::VARCHAR AS subject_id, source AS image FROM documents")
def csv_section(spark, d):
    """SC3, SK1."""
    path = scratch(spark, "section")
    files.write_rows(_subjects(spark, d).select("subject_id", "source"), path)
    return files.read_section(spark, path, "image")


@query(f"WITH {_SPLIT} SELECT doc_id::VARCHAR AS subject_id, phase FROM p")
def csv_partition(spark, d):
    """SC4, SK1: a split written in upper case and read as a partition file."""
    path = scratch(spark, "partition")
    split = C.random_split(table(spark, d, "documents"), "doc_id", 0.2, 0.1)
    files.write_rows(split.select(F.col("doc_id").cast("string").alias("subject_id"), F.upper("phase").alias("phase")), path)
    return files.read_partition(spark, path)


@query("SELECT doc_id::VARCHAR AS subject_id, quality::FLOAT AS quality, toxic::FLOAT AS toxic FROM labels WHERE quality = 1")
def csv_features_aligned(spark, d):
    """SC5: features of a CSV for the subjects of a catalog; those of other subjects are dropped."""
    path = scratch(spark, "features")
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("subject_id"), "quality", "toxic")
    files.write_rows(labels, path)
    return C.aligned(files.read_features(spark, path, ["quality", "toxic"]), labels.where("quality = 1").select("subject_id"))


@query("SELECT l_orderkey::VARCHAR AS subject_id, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY ((l_linenumber * 7919 + 4)::BIGINT * 1103515245 + 12345) % 2147483648, l_linenumber) = 1")
def csv_single_rows(spark, d):
    """SC21: one pseudo-random row of each subject."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("subject_id"), "l_linenumber")
    return files.subject_rows(rows, "l_linenumber", "single", 4)


@query("SELECT c_custkey AS index, c_acctbal::DOUBLE AS value, c_mktsegment AS segment FROM customer")
def csv_array_sink(spark, d):
    """SK2: rows with their index and a header."""
    path = scratch(spark, "array")
    files.write_rows(table(spark, d, "customer").select(F.col("c_custkey").alias("index"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("segment")), path, header=True)
    return spark.read.option("header", True).schema("index long, value double, segment string").csv(path)


@query("SELECT doc_id::VARCHAR AS subject_id, lang || '_' || doc_id || '_out.nii.gz' AS file FROM documents")
def manifest_sink(spark, d):
    """SK4."""
    path = scratch(spark, "manifest")
    files.write_manifest(_subjects(spark, d).select("subject_id", F.concat_ws("_", "lang", "subject_id", F.lit("out.nii.gz")).alias("file")), path)
    return spark.read.schema("subject_id string, file string").csv(path)


@query("""SELECT source, lang, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS dice FROM (SELECT source, lang, count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 1 AND quality <> 1) AS fp,
count(*) FILTER (toxic <> 1 AND quality = 1) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY ALL)""")
def evaluation_sink(spark, d):
    """SK5: frames by grouping key, each under a name of its keys."""
    rows = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    frame = M.overlap_metrics(M.confusion(rows, ["source", "lang"], F.col("toxic") == 1, F.col("quality") == 1), ["dice"])
    frames = {("source", "lang"): frame.select("source", "lang", F.round("dice", 6).alias("dice"))}
    (path,) = files.write_metrics(frames, scratch(spark, "metrics"))
    assert path.endswith("/eval_source_lang.csv")
    return spark.read.option("header", True).schema("source string, lang string, dice double").csv(path)


@query("SELECT l_returnflag AS key, k::INT AS place, v::DOUBLE AS value FROM (SELECT l_returnflag, [min(l_quantity)::DOUBLE, max(l_quantity)::DOUBLE, count(*)::DOUBLE] AS a FROM lineitem GROUP BY 1), unnest([0, 1, 2]) t(k), LATERAL (SELECT a[k + 1] AS v)")
def model_versions(spark, d):
    """SC18, SK6: a model as text, read, stored twice; the latest version counts and the former one stays."""
    text, path = scratch(spark, "model-text"), scratch(spark, "model")
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"), F.count("*").alias("c"))
    rows.select(F.concat_ws(" ", "l_returnflag", *[F.col(x).cast("string") for x in "abc"]).alias("value")).write.text(text)
    model = files.read_model(spark, text)
    files.write_model(model.where("key = 'A'"), path)
    files.write_model(model, path)
    return files.latest_model(spark, path).select("key", F.posexplode("landmarks").alias("place", "value"))


def _packed(spark, d):
    identity = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.array(*[F.lit(n) for n in SHAPE]).alias("shape"), identity.alias("affine"), F.array(*[F.lit(1.5)] * 3).alias("pixdim"), F.col("embedding").cast("array<float>").alias("voxels"))


@query(f"WITH {VOX} SELECT vec_id, x, y, z, value::FLOAT::DOUBLE AS value, 1.5::DOUBLE AS pixdim FROM vox")
def nifti_roundtrip(spark, d):
    """SC6, SC12, SC13, SK3: volumes as NIfTI-1 files, written and decoded by the first loader that can read them."""
    path = scratch(spark, "nifti")
    images.nifti_bytes(_packed(spark, d)).write.parquet(path)
    back = images.decoded(spark.read.parquet(path))
    rows = R.voxels_of(back.withColumn("vec_id", F.col("path").cast("long")), "vec_id")
    return rows.join(back.select(F.col("path").cast("long").alias("vec_id"), F.element_at("pixdim", 2).cast("double").alias("pixdim")), "vec_id")


@query(f"WITH {VOX} SELECT vec_id, x, y, z, round(value, 6) + 0 AS value FROM vox")
def volume_restored(spark, d):
    """SK3, F-A8, F-A9: turned from RAS to LPS and sampled twice as finely, then undone by the source's header."""
    there = V.zoom(V.reorient(vox(spark, d), SHAPE, "RAS", "ASL"), K, SHAPE, (7, 7, 7), 1)
    return rounded(V.restored(there, K, (7, 7, 7), "ASL", "RAS", SHAPE, 1))


@query("SELECT c_custkey::DOUBLE AS key_0, c_acctbal::DOUBLE AS key_1, c_custkey::INT AS coord_0, 0 AS coord_1, 1 AS coord_2, 2 AS coord_3, 3 AS coord_4, 4 AS coord_5, 5 AS coord_6 FROM customer")
def window_rows_sink(spark, d):
    """AG76: values of windows with their locations, in numbered columns, as CSV and back."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("double").alias("a"), F.col("c_acctbal").cast("double").alias("b"), F.col("c_custkey").cast("int").alias("image_id"), *[F.lit(i).alias(c) for i, c in enumerate(("x0", "y0", "z0", "x1", "y1", "z1"))])
    path = scratch(spark, "windows")
    files.write_rows(W.window_rows_csv(rows, ["a", "b"]), path, header=True)
    return spark.read.option("header", True).schema("key_0 double, key_1 double, " + ", ".join(f"coord_{i} int" for i in range(7))).csv(path)
