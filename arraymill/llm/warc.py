"""WARC archives, index first: an index of byte ranges is written with the records, and reads coalesce sorted ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, new_path, saved

DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id string, url string, digest string, payload_bytes long, record_type string, refers_to string, file string, offset long, length long"

_INDEX_TYPES = {"page_id": pa.string(), "url": pa.string(), "digest": pa.string(), "payload_bytes": pa.int64(), "record_type": pa.string(), "refers_to": pa.string(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64()}
_READ_TYPES = {"page_id": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload": pa.binary()}


def _batch(rows: list[tuple], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record as a gzip member of its own; a revisit has no block but names length and digest of its payload."""
    name = lambda x: f"<urn:page:{quote(x, safe='')}>"
    own = name(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"  # a record must have an id; this one names no page
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Record-ID: {own}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    body = payload
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Payload-Length: {len(payload)}"]
        body = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record in one gzip member; raises ValueError where its length or digest is wrong."""
    text = zlib.decompress(raw, 31)
    top, _, rest = text.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines)
    size = int(head["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("broken record")
    if head["WARC-Type"] != "revisit" and head["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(rest[:size]).hexdigest()}":
        raise ValueError("digest mismatch")
    return head, rest[:size]


def decide(pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """pages -> (page_id, url, payload, digest, refers_to, id): refers_to is set on revisits.

    Only digests of payloads with several pages form groups; a hot payload's pages meet its group by a bounded broadcast.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = attach(rows, groups, "digest", pages.count())
    refers = F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
    return joined.select(F.col("id").cast("string").alias("page_id"), "url", "payload", "digest", refers.cast("string").alias("refers_to"))


def write_warc(decided: DataFrame, path: str, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes archives of about file_bytes into the shared folder path and returns their index, itself a saved table.

    Files carry a fresh name for each task attempt, and only the attempts that Spark commits are in the index, so lost
    executors and retried or doubled tasks leave no wrong entry.
    """

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for row in rows:  # one file each round
            name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
            index: list[tuple] = []
            at = 0
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                while row is not None:
                    page_id, url, payload, digest, refers_to = row
                    kind = "response" if refers_to is None else "revisit"
                    raw = record(page_id, url, payload, digest, kind, refers_to)
                    out.write(raw)
                    index.append((page_id, url, digest, len(payload), kind, refers_to, name, at, len(raw)))
                    at += len(raw)
                    row = next(rows, None) if at < file_bytes else None
            yield _batch(index, _INDEX_TYPES)  # only once the file is closed

    return saved(decided.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, INDEX), "warc-index")


def read_warc(spark: SparkSession, path: str, selected: DataFrame, payloads: bool = False, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """Reads the selected records of the archives in path by coalesced byte ranges.

    Ranges are dealt to cells of `most` bytes by their offset, so no file is gathered whole; in a cell, sorted ranges
    with at most `gap` unwanted bytes between them become one read.
    selected: rows of the index. Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to and, on
    demand, the stored payload. A record whose length or digest is wrong raises an error.
    """
    cells = selected.groupBy("file", F.floor(F.col("offset") / most).alias("cell")).agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("members"))

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        name = lambda x: unquote(x[len("<urn:page:") : -1]) if x.startswith("<urn:page:") else None
        for batch in batches:
            rows: list[tuple] = []
            for file, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{file}") as source:
                    for run_ in coalesced([(m["offset"], m["length"]) for m in members], gap):
                        start = run_[0][0]
                        raw = source.read_at(run_[-1][0] + run_[-1][1] - start, start)
                        for offset, length in run_:
                            head, block = parse(raw[offset - start : offset - start + length])
                            revisit = head["WARC-Type"] == "revisit"
                            rows.append((name(head["WARC-Record-ID"]), unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None, int(head["X-Payload-Length"]) if revisit else len(block), head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"], name(head["WARC-Refers-To"]) if revisit else None, block if payloads else None))
            if rows:
                yield _batch(rows, _READ_TYPES)

    return cells.select("file", "members").mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def coalesced(members: list[tuple[int, int]], gap: int) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) ranges, grouped so that at most gap unwanted bytes lie between neighbours of a group."""
    out: list[list[tuple[int, int]]] = []
    for m in members:
        if out and m[0] - sum(out[-1][-1]) <= gap:
            out[-1].append(m)
        else:
            out.append([m])
    return out


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages as WARC archives with an index, then reads all their records back.

    Of pages with equal payloads of at least least_bytes, the one with the least id is stored as a response and the
    others as revisits of it; smaller payloads are all responses. Returns id_col, payload_bytes, payload_digest,
    record_type, refers_to. Null payloads count as empty, null urls are left out of the record, records of null
    ids have a random record id and come back with a null id; repeated rows are each written, and all copies of the first stay responses. An empty
    table writes no file and gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    index = write_warc(decide(pages, least_bytes, id_col, url_col, payload_col), path)
    back = read_warc(spark, path, index.select("file", "offset", "length"))
    return back.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
