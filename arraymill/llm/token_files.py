"""Token-ID output: Parquet list columns with dictionary encoding, small row groups and page indexes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions
from .tokens import LETTERS_OR_REST, EndedWordCache, by_size, cache, lowered

#: Parquet writer settings: dictionary pages for ids with delta encoding beyond them, row groups small enough to read
#: selectively, and short pages, each with its entry in the column index and the offset index.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "1000", "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> None:
    """Encodes whole texts and writes (part, row, id_col, part_start, n_tokens, tokens) in ascending id order.

    Texts are range-partitioned by id on sampled splitters and sorted, encoded after that shuffle (so that each text is
    encoded once), and written as one file per part, rows in id order. part_start counts the ids before a document in
    its part. The tokenizer must lower-case and drop white space: texts are cut at white space and before plain punctuation,
    and each word is encoded once per worker while it stays in a bounded table. Null texts count as empty and hold the end id
    only; null ids come first; rows of one id are in the order of a hash of their texts and then of the texts themselves,
    so start is reproducible; rows repeated in full each have an entry; an empty table gives an empty file. Other columns
    are not written.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        known = cache("ids", tokenizer_path, EndedWordCache)
        part, row, start = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<i4").tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in by_size(pc.binary_length(batch.column(1)).to_pylist(), batch_bytes):
                words = [LETTERS_OR_REST.findall(lowered(x)) for x in texts[a:b]]
                table = known.table(set().union(*words))
                packed = [b"".join([*map(table.__getitem__, x), end]) for x in words]
                sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
                ends = np.cumsum(sizes)
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                rows = np.arange(row, row + len(packed))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), part, np.int32)), pa.array(rows), batch.column(0).slice(a, b - a), pa.array(start + ends - sizes), pa.array(sizes), tokens], names=["part", "row", id_col, "part_start", "n_tokens", "tokens"])
                row += len(packed)
                start += int(ends[-1])

    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tied = [F.xxhash64("text"), F.col("text")]
    placed = texts.repartitionByRange(partitions(docs.sparkSession), F.col(id_col), tied[0]).sortWithinPartitions(F.col(id_col), *tied)
    placed.mapInArrow(encode, f"part int, row long, `{id_col}` {kind}, part_start long, n_tokens long, tokens array<int>").write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with `start`, the number of ids in all documents before; reads only the columns asked for.

    The sums of the parts (one row each, as many as shuffle partitions at the write) are broadcast.
    """
    rows = spark.read.parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write_tokens, then id_col, start, n_tokens, ids_crc32 of every document as read back from the files."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            ids = batch.column(2)
            ends = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).select(id_col, "start", "tokens").mapInArrow(digest, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")
