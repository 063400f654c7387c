"""SimHash near-dedup: bit planes stored vertically, compared with carry-save counters inside pigeonhole buckets."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import sliced
from .common import attach, partitions, saved
from .components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of the shingles of `size` words, repeats included; fewer words: of the whole sequence; none: empty."""
    words = (text or b"").translate(_LOWER).split()
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned integer; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65_536):
        part = hashes[a : a + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """Bit majority over the XXH64 of all word shingles, as an unsigned integer; 0 without words."""
    return majority(shingle_hashes(text, size, seed))


def _planes(lanes: np.ndarray) -> np.ndarray:
    """(blocks, 64 lanes) of fingerprints -> (64 bits, blocks): word b of a block holds bit b of its 64 lanes."""
    bits = np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), 64, 8), axis=2, bitorder="little")
    packed = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little"))
    return np.ascontiguousarray(packed.view(np.uint64)[:, :, 0].T)


def near(planes: np.ndarray, queries: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For items (query, block of 64 lanes): the items left, and a word of the lanes within radius of the query.

    Counters are kept as bit slices, one carry-save word per binary digit and a sticky overflow word; an item is
    abandoned as soon as all of its lanes exceed the radius.
    """
    digits = max(1, radius.bit_length())
    left = np.arange(len(queries))
    counters = np.zeros((digits, len(left)), np.uint64)
    over = np.zeros(len(left), np.uint64)
    q, k = queries, block
    for b in range(64):
        carry = planes[b][k] ^ (np.uint64(0) - ((q >> np.uint64(b)) & np.uint64(1)))
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        over |= carry
        if b % 8 == 7:
            far = over | _greater(counters, radius)
            alive = far != _ONES
            if not alive.all():
                left, counters, over, q, k = left[alive], counters[:, alive], over[alive], q[alive], k[alive]
            if not len(left):
                break
    return left, ~(over | _greater(counters, radius))


def _greater(counters: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced counter exceeds radius: compared digit by digit from the top."""
    greater = np.zeros(counters.shape[1], np.uint64)
    equal = np.full(counters.shape[1], _ONES)
    for d in reversed(range(len(counters))):
        if radius >> d & 1:
            equal &= counters[d]
        else:
            greater |= equal & counters[d]
            equal &= ~counters[d]
    return greater


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the label sets of a[i] and b[i], in place; a label is the least index of its set."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low = np.minimum(x, y)
        np.minimum.at(labels, np.maximum(x, y), low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def forest(group: np.ndarray, values: np.ndarray, radius: int, items: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """group: sorted bucket numbers of the values. Star edges (value, least linked value of its bucket component)."""
    n = len(values)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, n])
    keep = size > 1
    start, size = start[keep], size[keep]
    if not len(start):
        return values[:0], values[:0]
    blocks = -(-size // 64)
    first = np.r_[0, np.cumsum(blocks)[:-1]]
    of = np.repeat(np.arange(len(start)), blocks)
    at = start[of] + 64 * (np.arange(len(of)) - first[of])
    end = (start + size)[of]
    lane = at[:, None] + np.arange(64)
    valid = lane < end[:, None]
    lanes = values[np.minimum(lane, n - 1)]
    planes = np.concatenate([_planes(lanes[i : i + 4096]) for i in range(0, len(lanes), 4096)], axis=1)
    mask = np.packbits(valid, axis=1, bitorder="little").view(np.uint64)[:, 0]
    labels = np.arange(n)
    # each block against the queries of its bucket that stand in it or before it
    count = np.minimum(at + 64, end) - start[of]
    done = 0
    while done < len(of):
        upto = max(done + 1, int(np.searchsorted(np.cumsum(count[done:]), items, side="right")) + done)
        b = np.repeat(np.arange(done, upto), count[done:upto])
        row = start[of[b]] + (np.arange(len(b)) - np.repeat(np.r_[0, np.cumsum(count[done:upto])[:-1]], count[done:upto]))
        for s in range(0, len(b), 4 * items):
            kb, kr = b[s : s + 4 * items], row[s : s + 4 * items]
            left, hit = near(planes, values[kr], kb, radius)
            hit &= mask[kb[left]]
            some = np.flatnonzero(hit)
            for t in range(0, len(some), 20_000):
                part = some[t : t + 20_000]
                i, j = np.nonzero(np.unpackbits(hit[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                _join(labels, kr[left[part[i]]], at[kb[left[part[i]]]] + j)
        done = upto
    linked = np.flatnonzero(labels != np.arange(n))
    return values[linked], values[labels[linked]]


def links(prints: DataFrame, radius: int = 2, blocks: int | None = None, tile: int = 8192) -> DataFrame:
    """prints (fp long, distinct) -> edges (u, v) that join fingerprints at `radius` or fewer differing bits.

    Two fingerprints within the radius agree on blocks - radius of `blocks` bit blocks, so each choice of that many
    blocks is a table of exact buckets. A bucket of more than `tile` fingerprints is compared in pairs of tiles in
    separate tasks. Within a task only the forest of a bucket's links is returned, never all pairs.
    """
    blocks = blocks or radius + 2
    cuts = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [sum(((1 << int(cuts[i + 1])) - 1) ^ ((1 << int(cuts[i])) - 1) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])).alias("b")).select("fp", "b.*")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("a"), F.greatest(x, F.col("mine")).alias("b")))
    tiled = keyed.join(sizes, ["t", "key"]).withColumn("mine", mine).select("fp", "t", "key", F.explode(pairs).alias("p")).select("fp", "t", "key", "p.a", "p.b")
    task = F.xxhash64("t", "key", "a", "b")
    placed = tiled.select(task.alias("task"), "fp").repartition(partitions(prints.sparkSession), "task").sortWithinPartitions("task", "fp")

    def compare(batches):
        rest = None
        for batch in batches:
            g, v = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if rest is not None:
                g, v = np.concatenate([rest[0], g]), np.concatenate([rest[1], v])
            cutoff = int(np.searchsorted(g, g[-1])) if len(g) else 0
            rest = (g[cutoff:], v[cutoff:])
            if cutoff:
                yield _edges(*forest(g[:cutoff], v[:cutoff], radius))
        if rest is not None and len(rest[0]):
            yield _edges(*forest(rest[0], rest[1], radius))

    return placed.mapInArrow(compare, "u long, v long")


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def near_dedup(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """SimHash fingerprints of whole texts and the components of documents linked at `radius` or fewer differing bits.

    Equal fingerprints are one node, so copies cost nothing beyond a count; components come from distributed star
    steps, and documents find theirs by a join whose hot fingerprints go by a bounded broadcast.

    Returns id_col, fingerprint (16 hex digits), component_id (least id reachable) and, with carry, the input row as struct
    `row` and kept (true for one row of each component, of the least id; of rows that tie in it, the first as written).
    Null texts count as empty and have fingerprint zero; null ids get a component but never name one, unless a component
    has no other ids; repeated rows each get a row; an empty table gives an empty one; other columns are ignored.
    """
    carried = [F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key")] if carry else []
    more = ["row", "key"] if carry else []
    texts = docs.select(docs[id_col].alias("id"), *carried, F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    keys = texts.drop("text")
    names, before = [*keys.columns, "fp"], len(keys.columns)

    def run(batches):
        for batch in sliced(batches, 1024):
            prints = np.fromiter((fingerprint(x, shingle, seed) for x in batch.column(before).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:before], pa.array(prints.view(np.int64))], names=names)

    marked = saved(texts.mapInArrow(run, T.StructType([*keys.schema, T.StructField("fp", T.LongType())])), "simhash")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")) if carry else F.min("id")
    prints = marked.groupBy("fp").agg(least.alias("first"))
    found = components(links(prints.select("fp"), radius)).withColumnRenamed("node", "fp")
    joined = prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = joined.select("fp", "root").join(joined.groupBy("root").agg(F.min("first").alias("first")), "root").select("fp", "first")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    out = attach(marked, named, "fp", marked.count())
    if not carry:
        return out.select(F.col("id").alias(id_col), digits.alias("fingerprint"), F.col("first").alias("component_id"))
    return out.select(F.col("id").alias(id_col), digits.alias("fingerprint"), F.col("first.id").alias("component_id"), (F.col("key") == F.col("first.key")).alias("kept"), "row")
