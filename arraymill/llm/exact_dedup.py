"""Exact dedup: content sort over sampled range partitions, with full comparison of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, partitions


def exact_dedup(docs: DataFrame, keep: str = "smallest", normalise=None, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, carry: bool = False) -> DataFrame:
    """Groups rows whose normalised texts are byte for byte equal and names the row that stays.

    Spark samples splitters over (first prefix characters, hash) and range-partitions the texts by them, sorts each
    partition externally by (first characters, hash, whole text), so that equals stand next to each other, and a window
    over the whole text compares neighbours in full. The splitters hold no whole texts, so what the driver samples stays
    small. A text held by so many rows that it would fill a partition alone (see common.HOT_SHARE; there are few of these)
    never enters the sort: its rows are pre-aggregated map-side by the whole text and find their group by a broadcast of
    that bounded result. DataFrame functions only.

    keep: "smallest" or "largest" id. normalise: Column -> Column, by default none.
    Returns, for every input row, id_col, keep_id, group_size, kept, text_sha256 and, with carry, the input row as struct
    `row`. Null texts count as empty; null ids come last, and are kept only where a group has no other id. Rows that tie
    or are repeated in full are copies: one of them is kept. An empty table gives an empty one; other columns are ignored.
    """
    spark, low = docs.sparkSession, keep == "smallest"
    text: Column = F.coalesce(docs[text_col], F.lit(""))
    # the text travels once: beside it the other columns, and whether it was null
    rest = [c for c in docs.columns if normalise or c != text_col] if carry else []
    beside = F.struct(docs[text_col].isNull().alias("none"), *[docs[c].alias(f"c{i}") for i, c in enumerate(rest)]).alias("__rest")
    rows = docs.select(docs[id_col].alias("__id"), (normalise(text) if normalise else text).alias("__text"), *([beside] if carry else [])).withColumn("__h", F.xxhash64("__text"))
    row = F.struct(*[(F.col(f"__rest.c{rest.index(c)}") if c in rest else F.when(~F.col("__rest.none"), F.col("__text"))).alias(c) for c in docs.columns]).alias("row") if carry else None
    more = [row] if carry else []
    hot = hot_keys(rows.select("__h"), "__h", docs.count())
    some_hot = not hot.isEmpty()
    cold = rows.join(F.broadcast(hot), "__h", "left_anti") if some_hot else rows

    order = F.col("__id").asc_nulls_last() if low else F.col("__id").desc_nulls_last()
    equal = Window.partitionBy("__head", "__h", "__text")
    placed = cold.withColumn("__head", F.substring("__text", 1, prefix)).repartitionByRange(partitions(spark), "__head", "__h")
    out = placed.select(
        F.col("__id"),
        F.first("__id").over(equal.orderBy(order)).alias("keep_id"),
        F.count("*").over(equal).alias("group_size"),
        (F.row_number().over(equal.orderBy(order)) == 1).alias("kept"),
        F.sha2("__text", 256).alias("text_sha256"),
        *more,
    )
    if some_hot:
        found = rows.join(F.broadcast(hot), "__h", "left_semi")
        best = F.min("__id") if low else F.max("__id")
        groups = found.groupBy("__text").agg(best.alias("keep_id"), F.count("*").alias("group_size")).select(F.sha2("__text", 256).alias("text_sha256"), "keep_id", "group_size")
        member = found.select("__id", F.sha2("__text", 256).alias("text_sha256"), F.spark_partition_id().alias("__part"), *more).join(F.broadcast(groups), "text_sha256")
        # of the rows with the id that stays, the first of each part, and of these one
        stays = F.col("__id").eqNullSafe(F.col("keep_id"))
        inner = F.row_number().over(Window.partitionBy("text_sha256", "__part", stays).orderBy("__id"))
        member = member.withColumn("__first", stays & (inner == 1))
        outer = F.row_number().over(Window.partitionBy("text_sha256", "__first", F.when(~F.col("__first"), F.col("__part"))).orderBy("__part"))
        names = ["__id", "keep_id", "group_size", "kept", "text_sha256", *(["row"] if carry else [])]
        out = out.unionByName(member.withColumn("kept", F.col("__first") & (outer == 1)).select(*names))
    return out.withColumnRenamed("__id", id_col)
