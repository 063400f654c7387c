"""Near duplicates by shingle overlap: an exact similarity join, with SimHash links and MinHash bands ahead of it.

Fingerprints within a small radius miss most edited copies, so documents also meet in buckets of MinHash bands; a document
is compared with the first and the last of each of its buckets, so proposals are linear in documents however large a
bucket is. Every proposed pair is checked by the Jaccard similarity of the whole shingle sets. This finds most groups
cheaply; what it leaves out is found by prefixes: in one order of all shingles, rare ones first, two sets that are similar
enough share one of the first few shingles of each. Sets that meet there are compared unless they are in one group already,
so that large groups are not expanded into pairs, and no link between groups is lost.

Rows are written once, in blocks. Beside them travel keys, fingerprints, bands, pairs, and the shingle sets of documents
that are in a pair; a block gets back the keys of its rows that are in a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import bucketed, buckets_for, key_ranges, pack, released, sliced, tidy, tidy_pair, unpack
from .common import saved
from .components import components
from .simhash import links, majority, shingle_hashes

#: A document at the similarity 0.8 to another shares one of its bands with a chance of over 0.998.
BANDS, ROWS = 16, 5
#: Shingles of a range of classes that is counted at once, bits of a class beyond those of the number of shingles, sets of a tile.
RANGE, SPARE_BITS, TILE = 1 << 21, 6, 4096
#: Sets that meet at one shingle before those with more frequent ones are ordered again, and how often they are.
MANY, ROUNDS = 32, 4
BLOCK_BYTES, BLOCK_ROWS, ROW_BITS = 4 << 20, 1 << 15, 16
_A, _B = (np.array([xxhash.xxh64_intdigest(b"minhash", s + k) | (k == 0) for s in range(BANDS * ROWS)], np.uint64) for k in (0, 1 << 20))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed key a band of the distinct hashes of a text; none without hashes."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(hashes), 4096):
        v = (hashes[a : a + 4096, None] ^ _B) * _A
        np.minimum(least, (v ^ (v >> np.uint64(31))).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64)
    return keys.view(np.int64).tolist()


def _blocks(docs: DataFrame, text_col: str, block_bytes: int) -> DataFrame:
    """All columns of the rows as Arrow streams, in blocks; bucketed by block. Row i of block b has the key b << ROW_BITS | i."""

    def run(batches):
        block, parts, held, rows = TaskContext.get().partitionId() << 36 - ROW_BITS, [], 0, 0

        def emit():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for p in parts:
                    out.write_batch(p)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

        for part in sliced(batches):
            parts.append(part)
            held, rows = held + part.nbytes, rows + part.num_rows
            if held >= block_bytes or rows > BLOCK_ROWS:
                yield emit()
                block, parts, held, rows = block + 1, [], 0, 0
                released()
        if parts:
            yield emit()

    return bucketed(docs.mapInArrow(run, "block long, rows binary"), "near_rows", "block")


def _rows(cell: bytes) -> pa.Table:
    return pa.ipc.open_stream(cell).read_all().combine_chunks()


def _texts(table: pa.Table, text_col: str) -> list[bytes]:
    return [(x or "").encode() for x in table.column(text_col).to_pylist()]


def _pairs(prints: DataFrame, radius: int) -> DataFrame:
    """Proposed pairs (a, b) of keys, a < b, each once: by band, by fingerprint, and by links of fingerprints."""
    first = prints.groupBy("fp").agg(F.min("key").alias("first"))
    same = prints.select("fp", "key").join(first, "fp").select(F.col("first").alias("a"), F.col("key").alias("b"))
    near = links(first.select("fp"), radius)
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(n)) for c, n in (("u", "a"), ("v", "b"))]
    linked = near.join(ends[0], "u").join(ends[1], "v").select("a", "b")
    members = prints.select("key", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("band", "bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    met = members.join(buckets, ["band", "bucket"]).select("key", F.explode(F.array("low", "high")).alias("end"))
    banded = met.select(F.least("key", "end").alias("a"), F.greatest("key", "end").alias("b"))
    both = same.unionByName(linked).unionByName(banded)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _sets(left: pa.Table, right: pa.Table, text_col: str, shingle: int, seed: int, every: bool) -> list[tuple[int, int, np.ndarray]]:
    """(key, group so far, sorted shingle hashes) of the sets of a block: of all but copies, or of those on the right alone.
    Texts without words are left out."""
    if not left.num_rows or not (every or right.num_rows):
        return []
    base, texts = left.column("block")[0].as_py() << ROW_BITS, _texts(_rows(left.column("rows")[0].as_py()), text_col)
    root, skip = base + np.arange(len(texts)), np.full(len(texts), not every)
    i = right.column("key").to_numpy() - base
    root[i], skip[i] = right.column("root").to_numpy(), right.column("copy").to_numpy(zero_copy_only=False)
    held = [(k, np.unique(shingle_hashes(texts[k], shingle, seed))) for k in np.flatnonzero(~skip).tolist()]
    return [(base + k, int(root[k]), hashes) for k, hashes in held if len(hashes)]


def _classes(sets: list[tuple[int, int, np.ndarray]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes (first bits) of the shingles of some sets, each once and in order, and how many of the sets have each."""
    return np.unique(np.concatenate([h >> np.uint64(64 - bits) for *_, h in sets] or [np.zeros(0, np.uint64)]), return_counts=True)


def _class_bits(total: int) -> int:
    """So many that of `total` shingles about one in a hundred is in a class with another one."""
    return max(32, min(63, total.bit_length() + SPARE_BITS))


def _counts(blocks: DataFrame, known: DataFrame, text_col: str, shingle: int, seed: int, every: bool, total: int) -> DataFrame:
    """block, range, sets: in how many sets each class of a block's shingles is, in the order of _classes; a row for each range
    of classes that the block has some of. total: shingles of all these sets.

    The bits of a class and the number of ranges follow `total`, so that neither the chance of two shingles in one class nor a
    range's size grows with the data. Classes travel as packed differences, counts come back by position.
    """
    bits, ranges = _class_bits(total), buckets_for(total, RANGE)

    def sent(left: pa.Table, right: pa.Table) -> pa.Table:
        at, n = _classes(_sets(left, right, text_col, shingle, seed, every), bits)
        cells = [(r, pack(np.diff(at[a:b], prepend=np.uint64(0))), pack(n[a:b].astype(np.uint32))) for r, a, b in key_ranges(at, bits, ranges)] if len(at) else []
        block = pa.array([left.column("block")[0].as_py()] * len(cells) if cells else [], pa.int64())
        return pa.table([block, *[pa.array([c[i] for c in cells], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]], names=["block", "range", "classes", "n"])

    def added(table: pa.Table) -> pa.Table:
        at = [np.cumsum(unpack(x), dtype=np.uint64) for x in table.column("classes").to_pylist()]
        of = np.unique(np.concatenate(at), return_inverse=True)[1]
        sums = np.bincount(of, weights=np.concatenate([unpack(x) for x in table.column("n").to_pylist()]))[of].astype(np.uint32)
        parts = np.split(sums, np.cumsum([len(x) for x in at])[:-1])
        return pa.table([table.column("block"), table.column("range"), pa.array([pack(x) for x in parts], pa.binary())], names=["block", "range", "sets"])

    cells = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(tidy_pair(sent), "block long, range long, classes binary, n binary")
    return cells.groupBy("range").applyInArrow(tidy(added), "block long, range long, sets binary")


def _prefixes(blocks: DataFrame, groups: DataFrame, copies: DataFrame, text_col: str, shingle: int, seed: int, share: int, total: int, only: DataFrame | None = None) -> DataFrame:
    """token, key, root, n, pos: of each set the first shingles, rarest first, so many that similar sets share one; those that
    no other set has are left out of the rows. root is the group so far, n the size of the set. Sets that are equal to one of a
    lesser key are left out. Of the sets of the keys `only` (key, root, n), if given: by how many of these alone have a shingle.
    total: shingles of all sets.

    Any order gives the same groups; by whole counts few sets meet, as one with enough shingles of its own meets none."""
    every = only is None
    at = groups.select(F.col("node").alias("key"), "root").join(copies.select(F.col("v").alias("key"), F.lit(True).alias("copy")), "key", "left") if every else only.withColumn("copy", F.lit(False))
    known = at.select(F.shiftright("key", ROW_BITS).alias("block"), "key", "root", F.coalesce("copy", F.lit(False)).alias("copy"))
    total = total if every else only.agg(F.sum("n")).first()[0] or 0
    bits, names = _class_bits(total), ["token", "key", "root", "n", "pos"]

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [[np.zeros(0, np.int64)] for _ in names]
        found = _sets(left, right.filter(pc.is_valid(right.column("key"))), text_col, shingle, seed, every)
        if found:
            counted = right.filter(pc.is_valid(right.column("range"))).sort_by("range")
            sets = np.concatenate([unpack(x) for x in counted.column("sets").to_pylist()])
            classes, _ = _classes(found, bits)
            if len(sets) != len(classes):
                raise ValueError(f"block {left.column('block')[0]} has {len(classes)} classes of shingles and {len(sets)} counts")
        for key, root, hashes in found:
            n = len(hashes)
            m = sets[np.searchsorted(classes, hashes >> np.uint64(64 - bits))]
            order = np.lexsort((hashes, m))[: min(n, n + (-share * n // 1000) + 1)]
            pos = np.flatnonzero(m[order] > 1)
            for column, v in zip(parts, (hashes[order[pos]].view(np.int64), key, root, n, pos), strict=True):
                column.append(np.broadcast_to(np.asarray(v, np.int64), len(pos)))
        return pa.table([pa.array(np.concatenate(p)) for p in parts], names=names)

    counts = _counts(blocks, known, text_col, shingle, seed, every, total)
    both = known.unionByName(counts, allowMissingColumns=True)
    return saved(blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(tidy_pair(first), ", ".join(f"{c} long" for c in names)), "near_prefixes")


def _shared(prefixes: DataFrame) -> DataFrame:
    """token, key, root, n, pos, m, top: the prefix shingles of several groups, each with its number of sets and its largest
    group. Of shingles that are in the prefixes of the very same sets (told by 128 bits), as those of one passage are, the
    first stands for all: a pair of sets meets there once, not once a shingle."""
    by_root = prefixes.groupBy("token", "root").agg(F.count("*").alias("m"))
    sizes = by_root.groupBy("token").agg(F.sum("m").alias("m"), F.count("*").alias("roots"), F.max_by("root", "m").alias("top")).where("roots > 1").drop("roots")
    met = saved(prefixes.join(sizes, "token"), "near_meeting")  # few of all: most shingles are in one set
    sets = met.groupBy("token").agg(*[F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"d{i}") for i in (1, 2)])
    # each of the sets has all of these shingles, so that all agree on the least token and top
    rows = met.join(sets, "token").groupBy("d1", "d2", "m", "key", "root", "n").agg(F.min("token").alias("token"), F.min("pos").alias("pos"), F.min("top").alias("top"))
    return rows.select("token", "key", "root", "n", "pos", "m", "top")


def _pairs_of(shared: DataFrame, share: int, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of keys of different groups that share a row's shingle and can be similar enough by the sizes of their sets
    and by what follows the shingle. A shingle of more than `tile` sets is taken in pairs of tiles."""
    tiles = F.ceil(F.col("m") / tile).cast("int")
    mine = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j")))
    rows = shared.withColumn("tiles", tiles).withColumn("mine", mine).withColumn("p", F.explode(spread)).select("token", "p.i", "p.j", "mine", "key", "root", "n", "pos", (F.col("root") != F.col("top")).cast("int").alias("rest"))
    # sets of the largest group (0) meet the rest only, never each other; the rest (1) meet among themselves, too
    other = rows.where("rest = 1").select("token", "i", "j", F.explode(F.array(F.lit(0), F.lit(1))).alias("rest"), *[F.col(c).alias(f"{c}2") for c in ("mine", "key", "root", "n", "pos")])
    c = F.col
    # of sets of n and n2 shingles, `need` are shared at least; the first shared one leaves so many at most
    most = F.least(c("n") - c("pos"), c("n2") - c("pos2"))
    fits = (F.least("n", "n2") * 1000 >= F.greatest("n", "n2") * share) & (most * (1000 + share) >= (c("n") + c("n2")) * share)
    pairs = rows.join(other, ["token", "i", "j", "rest"]).where(((c("rest") == 0) | (c("key") < c("key2"))) & (c("root") != c("root2")) & ((c("mine") != c("mine2")) | (c("i") == c("j"))) & fits)
    return pairs.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()


def _met(prefixes: DataFrame, share: int, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of keys of different groups that share a shingle of both prefixes and can be similar enough."""
    return _pairs_of(_shared(prefixes), share, tile)


def _proposed(prefixes, share: int, many: int = MANY, rounds: int = ROUNDS) -> DataFrame:
    """The pairs of _met, with few meetings at frequent shingles. prefixes: keys (key, root, n) or None for all -> their prefixes.

    Sets meet at shingles of at most `many` sets, which makes pairs in proportion to rows. Those that have a more frequent
    one in their prefix are ordered again by how common shingles are among them alone: their own text comes first then, the
    lines that brought them together last. As similar sets share a prefix shingle in any order, none is lost: a pair meets at
    a shingle of few sets, or both are in the next round. The last round takes the pairs of all its shingles, and so does one
    after which not fewer than half of the sets would be left.
    """
    found, keys, left = None, None, None
    for i in range(rounds):
        shared = saved(_shared(prefixes(keys)), "near_shared")
        keys = saved(shared.where(F.col("m") > many).select("key", "root", "n").distinct(), "near_frequent")
        before, left = left, keys.count()
        last = not left or i == rounds - 1 or before is not None and 2 * left >= before
        pairs = _pairs_of(shared if last else shared.where(F.col("m") <= many), share)
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found.distinct() if i else found


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of texts whose sets of word shingles overlap by `similarity` or more (Jaccard, A-Z lower-cased).

    A group is a component of all pairs that pass: none is left out. Shingles are compared by their 64-bit hashes, equal sets
    by a digest of 128 bits. Where very many texts are nearly similar enough and not in one group, they are compared in
    pairs, by tiles in separate tasks. Texts of fewer words than a shingle are one shingle; texts without
    words are near copies of each other and of nothing else.

    Returns row (the input row as a struct), component_id (the least id of the group) and kept: true for one row of each
    group, of the least id; of rows that tie in it, the first as written. Null texts count as empty; null ids come after
    all others; repeated rows are near copies; an empty table gives an empty one; other columns are passed on.
    """
    kind = docs.schema[id_col].dataType
    blocks = _blocks(docs, text_col, block_bytes)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])

    def describe(batches):
        for batch in batches:
            for block, cell in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                prints, same, bands, sizes = [], [], [], []
                for text in _texts(_rows(cell), text_col):
                    hashes = shingle_hashes(text, shingle, seed)
                    prints.append(majority(hashes))
                    distinct = np.unique(hashes)
                    same.append(hashlib.blake2b(distinct.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(distinct))
                    sizes.append(len(distinct))
                keys = (block << ROW_BITS) + np.arange(len(prints))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=schema.names)
                released()

    prints = saved(blocks.mapInArrow(describe, schema), "near_prints")
    block_of = F.shiftright("key", ROW_BITS).alias("block")
    share = round(similarity * 1000)  # similarities are compared in whole thousandths

    def sets(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, found = right.column("key").to_pylist() if left.num_rows else [], []
        if keys:
            texts = _texts(_rows(left.column("rows")[0].as_py()), text_col)
            found = [np.unique(shingle_hashes(texts[k & (1 << ROW_BITS) - 1], shingle, seed)).view(np.int64) for k in keys]
        return pa.table([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["key", "shingles"])

    def passed(pairs: DataFrame) -> DataFrame:
        """Links (u, v): the pairs (a, b) whose whole sets are similar enough."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().select("key", block_of)
        held = saved(blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(tidy_pair(sets), "key long, shingles array<long>"), "near_sets")
        sides = [held.select(F.col("key").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab"]
        shared = F.size(F.array_intersect("sa", "sb")).cast("long")
        compared = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
        return compared.where(F.col("i") * 1000 >= F.lit(share) * (F.col("n") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v"))

    first = prints.groupBy("same").agg(F.min("key").alias("first"))
    copies = saved(prints.select("same", "key").join(first, "same").where("first < key").select(F.col("first").alias("u"), F.col("key").alias("v")), "near_copies")
    edges = saved(passed(saved(_pairs(prints, radius), "near_pairs")).unionByName(copies), "near_edges")
    groups = components(edges)
    total = prints.agg(F.sum("n")).first()[0] or 0
    proposed = _proposed(lambda keys: _prefixes(blocks, groups, copies, text_col, shingle, seed, share, total, keys), share)
    more = saved(passed(saved(proposed, "near_met")), "near_more")
    if not more.isEmpty():
        groups = components(edges.unionByName(more))

    def ids(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("key").to_numpy() if left.num_rows else np.zeros(0, np.int64)
        names = _rows(left.column("rows")[0].as_py()).column(id_col) if len(keys) else None
        taken = names.take(pa.array(keys & (1 << ROW_BITS) - 1)) if len(keys) else pa.array([], right.column("id").type)
        return pa.table([pa.array(keys), taken, right.column("root")], names=["key", "id", "root"])

    located = groups.select(F.col("node").alias("key"), "root", F.shiftright("node", ROW_BITS).alias("block"), F.lit(None).cast(kind).alias("id"))
    named_type = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", kind), T.StructField("root", T.LongType())])
    named = saved(blocks.groupBy("block").cogroup(located.groupBy("block")).applyInArrow(tidy_pair(ids), named_type), "near_groups")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    answers = named.join(first, "root").select("key", block_of, F.col("first.id").alias("id"), (F.col("first.key") == F.col("key")).alias("kept"))
    out_type = T.StructType([T.StructField("row", docs.schema), T.StructField("component_id", kind), T.StructField("kept", T.BooleanType())])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return None
        table = _rows(left.column("rows")[0].as_py())
        n, at = table.num_rows, right.column("key").to_numpy() & (1 << ROW_BITS) - 1
        place = np.arange(n)
        place[at] = n + np.arange(len(at))
        own = table.column(id_col).combine_chunks()
        component = pa.concat_arrays([own, right.column("id").combine_chunks().cast(own.type)]).take(pa.array(place))
        kept = np.ones(n, bool)
        kept[at] = right.column("kept").to_numpy(zero_copy_only=False)
        columns = [c.combine_chunks() for c in table.columns]
        return pa.table([pa.StructArray.from_arrays(columns, fields=list(table.schema)), component, pa.array(kept)], names=["row", "component_id", "kept"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_pair(answer), out_type)
