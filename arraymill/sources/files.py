"""Directories, CSV tables, model files and result sinks (SC1-SC5, SC18, SC21, SK1-SK7)."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import name_matches, subject_ids
from ..operators.catalog import PHASES, SUBJECT, duplicate_ids, portable_key


def resolve_paths(paths: str, home: str, exists) -> list[str]:
    """SC2: each comma-separated path as given or under home; `exists` tells which there are. Duplicates are dropped."""
    found = []
    for p in (x.strip() for x in paths.split(",") if x.strip()):
        hit = next((c for c in (p, f"{home.rstrip('/')}/{p}") if exists(c)), None)
        if hit is None:
            raise FileNotFoundError(p)
        found.append(hit)
    return list(dict.fromkeys(found))


def scan_directory(spark: SparkSession, path: str, contains: list[str] = (), excludes: list[str] = (), remove: str | None = None) -> DataFrame:
    """SC1, F-S1, AG68: (path, name, subject_id, candidates) of the files of a folder whose names match, contents unread.

    No match, or two files with the same first candidate, is an error. `remove` is a pattern cut out of the id instead.
    """
    from ..functions.strings import remove_from_id

    files = spark.read.format("binaryFile").load(path).select("path").withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    files = files.where(name_matches(F.col("name"), contains, excludes))
    ids = F.array(remove_from_id(F.col("name"), remove)) if remove else subject_ids(F.col("name"), list(contains))
    rows = files.withColumn("candidates", ids).withColumn(SUBJECT, F.get("candidates", F.lit(0)))
    if rows.isEmpty():
        raise ValueError(f"no file of {path} matches")
    if not duplicate_ids(rows, SUBJECT).isEmpty():
        raise ValueError("subject ids are not unique")
    return rows.select("path", "name", SUBJECT, "candidates")


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_section(spark: SparkSession, path: str, section: str) -> DataFrame:
    """SC3: a CSV without header: subject_id and the section, both strings, leading blanks skipped."""
    return spark.read.schema(_strings(SUBJECT, section)).csv(path, header=False, ignoreLeadingWhiteSpace=True)


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """SC4: (subject_id, phase) in lower case; an empty file or an unknown phase is an error."""
    rows = spark.read.schema(_strings(SUBJECT, "phase")).csv(path, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).withColumn("phase", F.lower("phase"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("phase").isNull() | ~F.col("phase").isin(*PHASES)).alias("bad")).first()
    if not counts["n"] or counts["bad"]:
        raise ValueError(f"empty partition file, or unknown phase: {path}")
    return rows


def read_features(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """SC5 (scan): subject_id and float columns of a CSV without header."""
    schema = T.StructType([T.StructField(SUBJECT, T.StringType()), *[T.StructField(c, T.FloatType()) for c in columns]])
    return spark.read.schema(schema).csv(path, header=False, ignoreLeadingWhiteSpace=True)


def subject_rows(rows: DataFrame, order: str, mode: str = "multi", seed: int = 0) -> DataFrame:
    """SC21: all rows of each subject, or one ("single") by a portable pseudo-random order of an integer column."""
    if mode == "multi":
        return rows
    w = Window.partitionBy(SUBJECT).orderBy(portable_key(F.col(order) * 7919 + seed), order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def write_rows(df: DataFrame, path: str, header: bool = False) -> None:
    """SK1, SK2: CSV files, with or without a header."""
    df.write.mode("overwrite").csv(path, header=header)


def write_manifest(outputs: DataFrame, path: str) -> None:
    """SK4: the (subject_id, file) manifest of a run, written anew."""
    outputs.select(SUBJECT, "file").write.mode("overwrite").csv(path, header=False)


def write_metrics(frames: dict[tuple[str, ...], DataFrame], folder: str) -> list[str]:
    """SK5: one folder of CSV for each grouping key, eval_<key>_<key>."""
    paths = []
    for key, df in frames.items():
        paths.append(f"{folder}/eval_{'_'.join(key)}.csv")
        df.write.mode("overwrite").csv(paths[-1], header=True)
    return paths


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """SC18: lines of a name and numbers -> (key, landmarks array<double>)."""
    parts = F.split(F.trim("value"), r"\s+")
    numbers = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.try_cast("double"))
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("key"), numbers.alias("landmarks"))


def write_model(model: DataFrame, path: str) -> None:
    """SK6: the model under a version of its own; `path` holds all versions, so a former one is never lost."""
    model.withColumn("version", F.lit(time.time_ns())).write.mode("append").partitionBy("version").parquet(path)


def latest_model(spark: SparkSession, path: str) -> DataFrame:
    """SK6: the model of the latest version."""
    rows = spark.read.parquet(path)
    top = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == top).drop("version")


def settings_text(settings: dict) -> str:
    """SK7: settings as text, sorted."""
    return json.dumps(settings, indent=2, sort_keys=True, default=str)
