"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir

#: A key is hot when it holds more than 1 / HOT_SHARE of an average shuffle partition's rows.
#: At most HOT_SHARE * (shuffle partitions) keys can be hot, which bounds every broadcast of hot keys.
HOT_SHARE = 4


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, partition_by: str | None = None, **options) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.options(compression="zstd", **options)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts: one column read. Numbers of groups follow it, so that a group's size does not grow with the data."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The keys of df that hold more than their share of rows; their number is bounded, see HOT_SHARE."""
    least = max(2, rows // (HOT_SHARE * partitions(df.sparkSession)))
    return cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > least).select(key))


def attach(df: DataFrame, groups: DataFrame, key: str, rows: int) -> DataFrame:
    """df left join groups (unique in key), hot keys of df by a bounded broadcast and the rest by a shuffle."""
    hot = hot_keys(df, key, rows)
    if hot.isEmpty():
        return df.join(groups, key, "left")
    hot = F.broadcast(hot)
    few = F.broadcast(groups.join(hot, key, "left_semi"))
    return df.join(hot, key, "left_anti").join(groups, key, "left").unionByName(df.join(few, key, "inner").select(*df.columns, *[c for c in groups.columns if c != key]))
