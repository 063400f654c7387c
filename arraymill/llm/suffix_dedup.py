"""Suffix-array dedup: sparse Burrows-Wheeler shards, merged by iterative interleave refinement.

Sorting every suffix of a corpus to a depth of 200 bytes is not needed to find its repeated 200-byte strings. Each
string is named by its minimiser, the first smallest hash of the 32-byte grams in it, so equal strings have the same
one at the same offset. Suffixes are kept only at those anchors (about one in 85 bytes): a lossless choice.

A shard is a section of a block's anchors. It sorts their suffixes once, by anchor hash and the bytes to the right, and
keeps in that order the symbols to the left of each (what a Burrows-Wheeler transform keeps), the depths that
neighbours share, and the order and depths of the same rows by their left symbols. A merge takes a hash range of all
shards and never sorts or compares the rows of one shard again: it holds an interleave, the shard of each place, and
refines it one symbol at a time in the intervals that still mix shards. The depths at which places of different shards
part, and inside a shard the depths it brought, are the common prefixes; intervals of both interleaves give the
repeated strings, compared in full.

An anchor with very many different contexts is hot: a merge would hold them all in one task. Its strings are sent one by
one instead, as 128-bit digests spread over all merges, each once a shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bucketed, buckets_for, key_ranges, pack, pack_bytes, ragged, released, sliced, tidy, tidy_pair, unpack
from .common import partitions

BLOCK_BYTES = 4 << 20
#: Starts that are hashed at a time, inside long texts too, and the bits that hold a place among them.
CHUNK, PLACE_BITS = 1 << 19, 20
#: Anchors of a shard at most.
SECTION = 1 << 16
#: Bytes of text for each task that counts anchors and for each that merges shards.
COUNT_BYTES, MERGE_BYTES = 32 << 20, 8 << 20
KEY_BITS = 56
#: An anchor hash is hot with more different contexts than this, each counted once a block.
HOT = 8192
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers of the base and of its inverse, kept for one chunk."""
    if n > len(_powers.get(0, ((),))[0]):
        made = []
        for base in (_BASE, _INVERSE):
            power = np.full(n, base)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            made.append(power)
        _powers[0] = (made[0], made[1])
    return _powers[0]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hashes of data[i : i + gram] for each i."""
    n = len(data)
    power, inverse = _powers_of(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = sums[gram:] - sums[: n - gram + 1]
    h *= inverse[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by running minima of blocks from both ends."""
    n = len(values)
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    fore = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])


class Anchors:
    """Anchors of a block in text order: place, hash, and the starts [low, high] of the strings that each one names.

    Starts are hashed in chunks of at most `chunk`, each with the size - 1 bytes after it, whatever the length of a text;
    where a chunk ends inside the strings of an anchor, the anchor has two entries.
    """

    def __init__(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, hash_: np.ndarray, context: np.ndarray):
        self.at, self.low, self.high, self.hash, self.context = at, low, high, hash_, context

    @classmethod
    def of(cls, data: np.ndarray, lengths: np.ndarray, size: int, gram: int, chunk: int = CHUNK) -> Anchors:
        ends = np.cumsum(lengths)
        holds = lengths >= size
        lo, hi = (ends - lengths)[holds], (ends - size + 1)[holds]
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.uint32))]
        for a in range(0, len(data), chunk):
            i, j = int(np.searchsorted(hi, a, side="right")), int(np.searchsorted(lo, a + chunk))
            if i < j:
                begin = np.maximum(lo[i:j], a)
                starts = ragged(begin - a, np.minimum(hi[i:j], a + chunk) - begin)
                found.append(cls._chunk(data[a : a + chunk + size - 1], a, starts, size, gram))
        return cls(*(np.concatenate(x) for x in zip(*found, strict=True)))

    @staticmethod
    def _chunk(data, offset, starts, size, gram):
        h = gram_hashes(data, gram)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        least = sliding_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), size - gram + 1)
        anchor = (least[starts] & mask).astype(np.int64)
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:] - 1, len(starts) - 1]
        at, low, high = anchor[first], starts[first], starts[last]
        context = (at - low).astype(np.uint64)
        for k in range(0, 2 * size - gram, gram):  # grams that cover the context, the last one repeated
            context = (context ^ h[np.minimum(low + k, high + size - gram)]) * _BASE
        # anchors are minima, so their hashes crowd at the low end: mixed once more, equal ranges of keys hold equal shares
        return at + offset, low + offset, high + offset, (h[at] * _BASE) >> np.uint64(64 - KEY_BITS), (context >> np.uint64(32)).astype(np.uint32)

    def packed(self) -> list[bytes]:
        place = np.diff(self.at, prepend=0).astype(np.int64).view(np.uint64)
        return [pack(place), pack((self.at - self.low).astype(np.uint16)), pack((self.at - self.high).astype(np.uint16)), pack(self.hash), pack(self.context)]

    @classmethod
    def unpacked(cls, blobs: list[bytes]) -> Anchors:
        place, left, right, hash_, context = map(unpack, blobs)
        at = np.cumsum(place.view(np.int64))
        return cls(at, at - left, at - right, hash_, context)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes, with their numbers of anchors and of different contexts."""
        order = np.lexsort((self.context, self.hash))
        key, context = self.hash[order], self.context[order]
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        fresh = new | np.r_[True, context[1:] != context[:-1]][: len(key)]
        start = np.flatnonzero(new)
        return key[start], np.diff(start, append=len(key)), np.diff(np.r_[0, np.cumsum(fresh)][np.r_[start, len(key)]])


def rows_of_symbols(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """(rows, width) bytes flat[begin], flat[begin + step], ... of each row, 0 beyond its length.

    A row is never asked for at depths beyond its length, so that 0 need not be told from a byte of the text.
    """
    out = np.zeros((len(begin), width), np.uint8)
    column = np.arange(width)
    for a in range(0, len(begin), 4096):
        there = column < length[a : a + 4096, None]
        out[a : a + 4096][there] = flat[(begin[a : a + 4096, None] + step * column)[there]]
    return out


def shared_depths(keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """For each row, the depth that it shares with the row before: 0 where the key is another one."""
    out = np.zeros(len(keys), np.uint16)
    for a in range(1, len(keys), 8192):
        now, before = symbols[a : a + 8192], symbols[a - 1 : a - 1 + len(symbols[a : a + 8192])]
        differ = now != before
        out[a : a + 8192] = np.where(differ.any(axis=1), differ.argmax(axis=1), symbols.shape[1])
    out[1:][keys[1:] != keys[:-1]] = 0
    return out


class Shard:
    """A section of a block's anchors as a sparse transform.

    Rows are the classes of equal (hash, right bytes, left bytes), sorted once in that order, left bytes read backwards:
    hash, left (number of symbols left of the anchor), right, weight (anchors of the class), common (depth shared with
    the row before). turn lists the rows in order of (hash, left bytes) and turn_common their depths. `of` is the row of
    each anchor.
    """

    def __init__(self, raw: bytes, anchors: Anchors, chosen: np.ndarray, size: int, gram: int, hot: np.ndarray):
        self.size, self.at = size, anchors.at[chosen]
        low, high, keys = anchors.low[chosen], anchors.high[chosen], anchors.hash[chosen]
        heads = keys.astype(">u8").tobytes()
        strings = [(heads[8 * i : 8 * i + 8] + raw[p:b], raw[a:p][::-1]) for i, (a, p, b) in enumerate(zip(low.tolist(), self.at.tolist(), (high + size).tolist(), strict=True))]
        order = sorted(range(len(strings)), key=strings.__getitem__)
        fresh = np.fromiter((not k or strings[order[k]] != strings[order[k - 1]] for k in range(len(order))), bool, len(order))
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        kept = np.array(order, np.int64)[fresh]
        self.weight = np.bincount(self.of, minlength=len(kept)).astype(np.uint32)
        self.hash, self.begin, self.anchor, self.end = keys[kept], low[kept], self.at[kept], (high + size)[kept]
        self.left, self.right = self.anchor - self.begin, self.end - self.anchor
        turned = [(strings[i][0][:8], strings[i][1]) for i in kept.tolist()]
        del strings
        self.turn = np.array(sorted(range(len(turned)), key=turned.__getitem__), np.int64)
        del turned
        flat = np.frombuffer(raw, np.uint8)
        self.common = shared_depths(self.hash, rows_of_symbols(flat, self.anchor, self.right, size))
        self.turn_common = shared_depths(self.hash[self.turn], rows_of_symbols(flat, self.anchor[self.turn] - 1, self.left[self.turn], size - gram, -1))
        self.raw, self.hot = raw, np.isin(self.hash, hot)

    def contexts(self, rows: np.ndarray) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.begin[rows].tolist(), self.end[rows].tolist(), strict=True)]

    def strings(self, most: int = 1024):
        """For parts of the hot rows: row, distance left of the anchor and 128-bit digest of each of their strings."""
        rows = np.flatnonzero(self.hot)
        for a in range(0, len(rows), most):
            part = rows[a : a + most]
            number = self.left[part] + self.right[part] - self.size + 1
            begin = ragged(np.zeros(len(part), np.int64), number)
            of = np.repeat(part, number)
            digests = b"".join(hashlib.blake2b(self.raw[b : b + self.size], digest_size=16).digest() for b in (self.begin[of] + begin).tolist())
            yield of, self.left[of] - begin, np.frombuffer(digests, np.uint64).reshape(-1, 2)


def interleaved(keys: np.ndarray, shard: np.ndarray, symbols: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges sorted shards by refining their interleave.

    Rows stand shard after shard, each shard in its order of (key, symbols); own: the depth that a row shares with the
    row before in its shard. z holds the shard of each place, beginning with the interleave by key alone; its occurrences
    of a shard stand for that shard's rows in their own order, so a step only deals places out by the next symbol, in
    intervals that hold several shards; an interval of one shard is settled.
    Returns the row at each place and the depth shared with the place before.
    """
    row = np.argsort(keys, kind="stable")
    z = shard[row]
    first = np.r_[True, keys[row][1:] != keys[row][:-1]][: len(row)]
    new, common = first.copy(), np.where(first, 0, symbols.shape[1])
    changed, active, interval = True, row[:0], row[:0]
    for depth in range(symbols.shape[1]):
        if changed:
            start = np.flatnonzero(new)
            mixed = (np.minimum.reduceat(z, start) != np.maximum.reduceat(z, start)) if len(start) else new
            interval = np.cumsum(new) - 1
            active = np.flatnonzero(mixed[interval])
            interval = interval[active]
            changed = False
        if not len(active):
            break
        s = symbols[row[active], depth]
        if not ((s[1:] != s[:-1]) & (interval[1:] == interval[:-1])).any():
            continue
        key = (interval << 8) | s
        inner = np.argsort(key, kind="stable")  # a counting step: places of an interval by symbol, shards in their order
        row[active], z[active], key = row[active][inner], z[active][inner], key[inner]
        fresh = active[1:][(key[1:] != key[:-1]) & ~new[active[1:]]]
        new[fresh], common[fresh], changed = True, depth, True
    inside = np.flatnonzero(~first & np.r_[False, z[1:] == z[:-1]][: len(z)])
    common[inside] = own[row[inside]]
    return row, common


def _at_depth(order: np.ndarray, common: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """The interval of each row at a depth."""
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(first | (common < depth))
    return group


def repeated(held: list[dict], size: int, gram: int) -> np.ndarray:
    """held: shards (hash, weight, left, right, common, turn, turn_common, contexts as one array of bytes), each sorted.

    For all rows, shard after shard: whether the string at each distance d = 0 .. size - gram left of the anchor occurs
    at least twice over all shards.
    """
    width = size - gram + 1
    count = np.array([len(h["hash"]) for h in held])
    base = np.cumsum(count) - count
    shard = np.repeat(np.arange(len(held), dtype=np.int32), count)
    joined = lambda c: np.concatenate([h[c] for h in held])
    keys, weight, left, right = joined("hash"), joined("weight"), joined("left").astype(np.int64), joined("right").astype(np.int64)
    flat = joined("contexts")
    anchor = np.cumsum(left + right) - right
    least = left + size - (left + right)  # distances least .. left are a row's own
    mine = (np.arange(width) >= least[:, None]) & (np.arange(width) <= left[:, None])
    out = mine & (weight > 1)[:, None]

    row, common = interleaved(keys, shard, rows_of_symbols(flat, anchor, right, size), joined("common"))
    turn = np.concatenate([h["turn"].astype(np.int64) + b for h, b in zip(held, base.tolist(), strict=True)])
    back, back_common = interleaved(keys[turn], shard, rows_of_symbols(flat, anchor[turn] - 1, left[turn], size - gram, -1), joined("turn_common"))
    back = turn[back]
    first, back_first = (np.r_[True, keys[x][1:] != keys[x][:-1]][: len(x)] for x in (row, back))
    several = np.flatnonzero(np.bincount(np.cumsum(first))[np.cumsum(first)] > 1)
    some = np.zeros(len(row), bool)
    some[row[several]] = True
    for d in range(width):
        active = np.flatnonzero(some & mine[:, d])
        if len(active) < 2:
            continue
        pair = _at_depth(row, common, first, size - d)[active] * (len(row) + 1) + _at_depth(back, back_common, back_first, d)[active]
        _, number = np.unique(pair, return_inverse=True)
        out[active, d] |= np.bincount(number, weights=weight[active])[number] > 1
    return out


def summed(digests: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct digests in order, the sums of their weights, and the place of each row's digest among them."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    ranked = digests[order]
    new = np.r_[True, (ranked[1:] != ranked[:-1]).any(axis=1)][: len(ranked)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], np.bincount(number, weights=weight, minlength=int(new.sum())), number


_COUNTS = "block long, bucket int, keys binary, counts binary, various binary"
_SHARDS = "block long, section int, bucket int, keys binary, numbers array<binary>, lengths binary, contexts binary, high binary, low binary"
_ANSWERS = "block long, section int, bucket int, bits binary, high binary, low binary"


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))})


def _texts(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, size: int, gram: int) -> DataFrame:
    """Texts and their anchors in blocks, written once, bucketed by block."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def emit():
            own = pa.concat_arrays(ids)
            lengths, content = pack_bytes(texts)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            found = Anchors.of(np.frombuffer(b"".join(texts), np.uint8), sizes, size, gram)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
            cells = [pa.array([x], t) for x, t in zip((block, held, lengths, content, found.packed()), types, strict=True)]
            return pa.RecordBatch.from_arrays([*cells, pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], names=["block", "bytes", "lengths", "texts", "anchors", "ids"])

        for part in sliced(batches):
            ids.append(part.column(0))
            new = part.column(1).to_pylist()
            texts += new
            held += sum(map(len, new))
            if held >= block_bytes:
                yield emit()
                block, ids, texts, held = block + 1, [], [], 0
                released()
        if ids:
            yield emit()

    return bucketed(rows.mapInArrow(run, f"block long, bytes long, lengths binary, texts binary, anchors array<binary>, ids array<{kind}>"), "suffix_texts", "block")


def _raw(texts: bytes) -> bytes:
    n = int.from_bytes(texts[:8], "little")
    return pa.Codec("zstd").decompress(texts[8:], n, asbytes=True) if n else b""


def _runs(start: np.ndarray, size: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed runs [begin, end) and their texts, from a flag at every start of a repeated string."""
    edge = np.flatnonzero(np.diff(start, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2] - 1 + size
    text = np.searchsorted(ends, begin, side="right")
    new = np.r_[True, (text[1:] != text[:-1]) | (begin[1:] > end[:-1])][: len(begin)]
    last = np.r_[new[1:], True][: len(begin)]
    return begin[new], end[last], text[new]


def _kept(raw: bytes, begin: np.ndarray, end: np.ndarray, text: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of each text outside its runs."""
    runs: dict[int, list[tuple[int, int]]] = {}
    for i, a, b in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True):
        runs.setdefault(i, []).append((a, b))
    out, at = [], 0
    for i, stop in enumerate(ends.tolist()):
        parts = []
        for a, b in runs.get(i, ()):
            parts.append(raw[at:a])
            at = b
        parts.append(raw[at:stop])
        out.append(b"".join(parts) if len(parts) > 1 else parts[0])
        at = stop
    return out


def remove_repeats(docs: DataFrame, size: int = 200, gram: int = 32, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot: int = HOT, section: int = SECTION, merge_bytes: int = MERGE_BYTES, keep_bytes: bool = True) -> DataFrame:
    """Removes every byte covered by a `size`-byte string that also starts anywhere else, in whole texts as UTF-8 bytes.

    Texts are written once in blocks with their anchors, bucketed, and never shuffled. Anchor hashes go by range to a
    count; only anchors that occur at least twice enter shards, which go by hash range to merges; what comes back is a
    bit for each string. Anchors with more than `hot` contexts send a 128-bit digest of each string, by range of digest;
    what comes back is the repeated ones. The numbers of counts and merges follow the bytes of the texts. A long text is
    hashed in chunks and sorted in sections. Strings are judged on the input and never cross texts.

    Returns id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with keep_bytes, kept (binary).
    Null texts count as empty; texts shorter than `size` keep all; null ids pass through; repeated rows are copies and
    lose all strings of `size` bytes; an empty table gives an empty one; other columns are ignored.
    """
    kind, spread = docs.schema[id_col].dataType.simpleString(), partitions(docs.sparkSession)
    blocks = _texts(docs, id_col, text_col, block_bytes, size, gram)
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    counts, merges = buckets_for(total, COUNT_BYTES), buckets_for(total, merge_bytes)

    def send(batches):
        for batch in batches:
            for block, anchors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, n, various = Anchors.unpacked(anchors).counted()
                rows = [{"block": block, "bucket": k, "keys": pack(np.diff(keys[a:b], prepend=np.uint64(0))), "counts": pack(n[a:b].astype(np.uint32)), "various": pack(various[a:b].astype(np.uint32))} for k, a, b in key_ranges(keys, KEY_BITS, counts)]
                yield from _table(_COUNTS, rows).to_batches()

    def count(table: pa.Table) -> pa.Table:
        held = [(b, np.cumsum(unpack(keys), dtype=np.uint64), unpack(n), unpack(v)) for b, keys, n, v in zip(*(table.column(c).to_pylist() for c in ("block", "keys", "counts", "various")), strict=True)]
        distinct, number = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
        often, many = (np.bincount(number, weights=np.concatenate([h[i] for h in held]), minlength=len(distinct)) > least for i, least in ((2, 1), (3, hot)))
        rows, at = [], 0
        for block, keys, *_ in held:
            of = number[at : at + len(keys)]
            mine = often[of]
            at += len(keys)
            if mine.any():
                rows.append({"block": block, "bucket": table.column("bucket")[0].as_py(), "keys": pack(np.diff(keys[mine], prepend=np.uint64(0))), "counts": pack(many[of][mine].astype(np.uint8))})
        return _table(_COUNTS, rows)

    hashes = blocks.select("block", "anchors").mapInArrow(send, _COUNTS)
    often = bucketed(hashes.groupBy("bucket").applyInArrow(tidy(count), _COUNTS).select("block", "bucket", "keys", "counts").repartition(spread, "block"), "suffix_often", "block")

    def shards(left: pa.Table, right: pa.Table):
        """The raw bytes of a block, and its shards with their numbers."""
        raw = _raw(left.column("texts")[0].as_py())
        none = np.zeros(0, np.uint64)
        keys = np.concatenate([none, *(np.cumsum(unpack(k), dtype=np.uint64) for k in right.column("keys").to_pylist())])
        many = np.concatenate([none, *(unpack(n) for n in right.column("counts").to_pylist())]) > 0
        anchors = Anchors.unpacked(left.column("anchors")[0].as_py())
        chosen = np.flatnonzero(np.isin(anchors.hash, keys))
        return raw, ((k, Shard(raw, anchors, chosen[a : a + section], size, gram, keys[many])) for k, a in enumerate(range(0, len(chosen), section)))

    def transform(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            block = left.column("block")[0].as_py()
            for number, s in shards(left, right)[1]:
                cold = np.flatnonzero(~s.hot)
                place = np.full(len(s.hot), -1, np.int64)
                place[cold] = np.arange(len(cold))
                turn = place[s.turn]
                kept = turn >= 0
                turn, turn_common = turn[kept], s.turn_common[kept]  # hot rows go by whole hashes, so what is left stays sorted
                for k, a, b in key_ranges(s.hash[cold], KEY_BITS, merges):
                    rows_ = cold[a:b]
                    lengths, contexts = pack_bytes(s.contexts(rows_))
                    numbers = (s.weight[rows_], s.left[rows_].astype(np.uint16), s.common[rows_], (turn[a:b] - a).astype(np.uint32), turn_common[a:b])
                    rows.append({"block": block, "section": number, "bucket": k, "keys": pack(np.diff(s.hash[rows_], prepend=np.uint64(0))), "numbers": [pack(x) for x in numbers], "lengths": lengths, "contexts": contexts})
                for of, _, digests in s.strings():
                    digests, n, _ = summed(digests, s.weight[of])
                    for k, a, b in key_ranges(digests[:, 0], 64, merges):
                        rows.append({"block": block, "section": number, "bucket": k, "numbers": [pack(np.minimum(n[a:b], 2).astype(np.uint8))], "high": pack(digests[a:b, 0].copy()), "low": pack(digests[a:b, 1].copy())})
        return _table(_SHARDS, rows)

    def again(table: pa.Table) -> list[dict]:
        """For rows of digests: those that occur at least twice over all rows."""
        held = [(b, s, np.stack([unpack(x), unpack(y)], axis=1), unpack(n[0])) for b, s, x, y, n in zip(*(table.column(c).to_pylist() for c in ("block", "section", "high", "low", "numbers")), strict=True)]
        if not held:
            return []
        _, sums, number = summed(np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))
        out, at = [], 0
        for block, part, digests, _ in held:
            mine = digests[sums[number[at : at + len(digests)]] > 1]
            at += len(digests)
            if len(mine):
                out.append({"block": block, "section": part, "bucket": table.column("bucket")[0].as_py(), "high": pack(mine[:, 0].copy()), "low": pack(mine[:, 1].copy())})
        return out

    def merge(table: pa.Table) -> pa.Table:
        rows = again(table.filter(pc.is_null(table.column("contexts"))))
        table = table.filter(pc.is_valid(table.column("contexts")))
        if table.num_rows:
            held, names = [], []
            for block, part, keys, numbers, lengths, contexts in zip(*(table.column(c).to_pylist() for c in ("block", "section", "keys", "numbers", "lengths", "contexts")), strict=True):
                weight, left, common, turn, turn_common = map(unpack, numbers)
                names.append((block, part))
                held.append({"hash": np.cumsum(unpack(keys), dtype=np.uint64), "weight": weight, "left": left, "right": unpack(lengths).astype(np.int64) - left, "common": common, "turn": turn, "turn_common": turn_common, "contexts": np.frombuffer(_raw(contexts), np.uint8)})
            bits, at = np.packbits(repeated(held, size, gram), axis=1), 0
            for (block, part), h in zip(names, held, strict=True):
                n = len(h["hash"])
                rows.append({"block": block, "section": part, "bucket": table.column("bucket")[0].as_py(), "bits": pack(bits[at : at + n].reshape(-1))})
                at += n
        return _table(_ANSWERS, rows)

    pair = blocks.select("block", "texts", "anchors").groupBy("block").cogroup(often.groupBy("block"))
    judged = pair.applyInArrow(tidy_pair(transform), _SHARDS).groupBy("bucket").applyInArrow(tidy(merge), _ANSWERS)
    # one table with both: what is often (and hot), and what was judged: bits of rows, or both halves of digests
    nothing = F.lit(None).cast("binary")
    answers = often.select("block", F.lit(-1).alias("section"), "bucket", "keys", "counts", *[nothing.alias(c) for c in ("bits", "high", "low")])
    answers = answers.unionByName(judged.select("block", "section", "bucket", nothing.alias("keys"), nothing.alias("counts"), "bits", "high", "low"))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return None
        raw, own = shards(left, right.filter(pc.is_valid(right.column("keys"))))
        lengths = unpack(left.column("lengths")[0].as_py()).astype(np.int64)
        ends = np.cumsum(lengths)
        width = size - gram + 1
        start = np.zeros(len(raw), bool)
        found: dict[int, list] = {}
        for part, *answer in zip(*(right.column(c).to_pylist() for c in ("section", "bucket", "bits", "high", "low")), strict=True):
            found.setdefault(part, []).append(answer)
        for number, s in own:
            mine = found.get(number, [])
            table = np.zeros((len(s.hash), -(-width // 8)), np.uint8)
            parts = [unpack(bits) for _, bits, *_ in sorted((a for a in mine if a[1] is not None), key=lambda a: a[0])]
            if parts:
                table[~s.hot] = np.concatenate(parts).reshape(-1, table.shape[1])
            twice = [np.stack([unpack(x), unpack(y)], axis=1) for _, _, x, y in mine if x is not None]
            twice = np.concatenate(twice) if twice else np.zeros((0, 2), np.uint64)
            for of, d, digests in s.strings():
                _, sums, place = summed(np.concatenate([twice, digests]), np.r_[np.ones(len(twice)), np.zeros(len(digests))])
                hit = sums[place[len(twice) :]] > 0
                np.bitwise_or.at(table, (of[hit], d[hit] // 8), (128 >> (d[hit] % 8)).astype(np.uint8))
            for a in range(0, len(s.at), 8192):
                i, d = np.nonzero(np.unpackbits(table[s.of[a : a + 8192]], axis=1, count=width))
                start[s.at[a : a + 8192][i] - d] = True
        begin, end, text = _runs(start, size, ends)
        n_spans = np.bincount(text, minlength=len(ends))
        n_removed = np.bincount(text, weights=end - begin, minlength=len(ends)).astype(np.int64)
        kept = _kept(raw, begin, end, text, ends)
        out = {id_col: pa.concat_arrays(left.column("ids").chunks).flatten(), "n_bytes": pa.array(lengths), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        if keep_bytes:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return blocks.select("block", "ids", "lengths", "texts", "anchors").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_pair(remove), schema)
