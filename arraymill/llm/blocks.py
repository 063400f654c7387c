"""Blocks of documents with a dictionary of their own: every distinct word of a block is named once, texts become codes.

A block holds about a given number of characters. Its table row for documents keeps ids, word counts and codes (in rank
order of frequency, so that they compress); its dictionary rows, one per bucket, keep the block's words of that bucket.
Whatever is looked up about words is looked up once per distinct word of a block, and comes back to the block by code.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import new_path, partitions

_CODEC = "zstd"
#: Texts in an Arrow batch while blocks are written: batches hold far less than a block.
BATCH_ROWS = 1_000
_made: list[str] = []


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32 or 64 bit integers as compressed byte planes."""
    width = values.dtype.itemsize
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()
    return len(raw).to_bytes(8, "little") + bytes([width]) + pa.Codec(_CODEC, compression_level=1).compress(raw, asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    size, width = int.from_bytes(blob[:8], "little"), blob[8]
    raw = pa.Codec(_CODEC).decompress(blob[9:], size, asbytes=True) if size else b""
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[width])


def pack_bytes(parts: list[bytes]) -> tuple[bytes, bytes]:
    """Byte strings as (packed lengths, compressed content)."""
    raw = b"".join(parts)
    return pack(np.fromiter(map(len, parts), np.uint32, len(parts))), len(raw).to_bytes(8, "little") + pa.Codec(_CODEC, compression_level=1).compress(raw, asbytes=True)


def unpack_bytes(lengths: bytes, blob: bytes) -> list[bytes]:
    size = int.from_bytes(blob[:8], "little")
    raw = pa.Codec(_CODEC).decompress(blob[8:], size, asbytes=True) if size else b""
    ends = np.cumsum(unpack(lengths), dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def ranked(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct values, code of each value), codes in falling order of frequency."""
    coded = values.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    n = len(coded.dictionary)
    order = np.argsort(-np.bincount(codes, minlength=n), kind="stable")
    rank = np.empty(n, np.uint32)
    rank[order] = np.arange(n, dtype=np.uint32)
    return coded.dictionary.take(pa.array(order)), rank[codes] if n else np.zeros(0, np.uint32)


def sliced(batches, rows: int = 256):
    """Arrow batches cut into slices of at most `rows` rows: a block closes near its size even where one batch holds more."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def buckets_for(total: int, each: int) -> int:
    """Buckets of about `each` bytes for a total: their number follows the data, so that a group's size does not."""
    return max(1, -(-total // each))


def key_ranges(keys: np.ndarray, bits: int, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets, equal ranges of keys of `bits` bits, that hold some of the sorted keys; buckets < 2 ** 32."""
    of = ((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    edge = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)]), len(of)]
    return [(int(of[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def by_bucket(words: list[bytes], buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, numbers of its words in order) of the buckets that hold some of the words."""
    of = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(of, kind="stable")
    edge = np.r_[np.flatnonzero(np.diff(of[order], prepend=-1)), len(order)]
    return [(int(of[order[a]]), order[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def released() -> None:
    """Gives freed memory back to the system at the end of a group or block: workers are reused, idle ones stay for a
    while, and an executor holds several, so what one of them keeps from its largest group counts many times."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f):
    """f(table) for applyInArrow, with freed memory given back after each group."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        released()
        return out

    return run


def tidy_pair(f):
    """f(left, right) for a cogroup's applyInArrow, with freed memory given back after each group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        released()
        return out

    return run


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df written once, bucketed by key, in the shared folder: joins and groups by key need no exchange of it."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    with _batches_of(spark, BATCH_ROWS):
        df.write.option("path", new_path(spark, name)).option("compression", "zstd").bucketBy(partitions(spark), key).format("parquet").saveAsTable(table)
    _made.append(table)
    return spark.table(table)


@contextlib.contextmanager
def _batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows for what is executed inside, as the session had them afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_tables(spark: SparkSession) -> None:
    """Drops the catalog entries of all blocks written so far by this process; call it when their results have been used.

    Their files lie in the shared folder and are cleared with it.
    """
    while _made:
        spark.sql(f"DROP TABLE IF EXISTS {_made.pop()}")
