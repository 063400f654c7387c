"""Substring dedup: relative Lempel-Ziv parsing of documents against an index of all reference blocks.

A document is parsed left to right into factors: runs of words that stand in a document of a smaller id. Trying every
reference block in turn would take blocks squared, so all blocks share one index, and a document looks up only where a
long factor can be. Every window of `size` words is named by its minimiser, the first smallest hash of the `gram`-word
grams in it; equal windows have equal minimisers at the same offset, so a factor of `size` words or more always holds one.
Neighbouring windows with the same minimiser form a context, and contexts are the index entries: about one for 18 words.

The parse is greedy: a context that stands whole in an earlier document is a factor, or lengthens the one before it where
both continue in the same place of the same document. A context that doesn't, while its minimiser is known with other
contexts, holds the boundary of a factor: there, and only there, each window is looked up by itself.

Contexts and windows are compared by BLAKE2b digests of 128 bits: two of N different ones are taken for equal with a
chance of about N^2 / 2^129. Minimiser hashes only choose candidates. An index entry is the least (id, place) of a digest,
by an aggregate that combines before it shuffles, so copies in any number cost a row a task; no group of documents is ever
gathered.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import bucketed, pack_bytes, released, sliced, tidy_pair, unpack_bytes
from .common import saved

BLOCK_BYTES = 4 << 20
#: Bytes of words hashed at a time, and windows whose minimisers are sought at a time.
CHUNK, WINDOWS = 1 << 19, 1 << 17
_SPACE = re.compile(rb"[\x20\x09-\x0d]+")
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(CHUNK, _BASE, np.uint64)])
_INVERSES = np.multiply.accumulate(np.r_[np.uint64(1), np.full(CHUNK, pow(_BASE, -1, 1 << 64), np.uint64)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a block's texts, in a row: `raw` holds them with one space after each, `at` where each begins."""

    def __init__(self, texts: list[bytes]):
        self.text = b"".join(t + b" " for t in texts if t)
        self.raw = np.frombuffer(self.text, np.uint8)
        self.at = np.r_[0, np.flatnonzero(self.raw == 32) + 1]
        self.n = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        self.begin = np.r_[0, np.cumsum(self.n)]

    def hashes(self) -> np.ndarray:
        """A hash of each word, by its bytes and the space after them; a very long word is hashed by pieces."""
        out, a, n = [np.zeros(0, np.uint64)], 0, len(self.at) - 1
        while a < n:
            b = int(np.searchsorted(self.at, self.at[a] + CHUNK, side="right")) - 1
            if b > a:
                first, part = self.at[a], self.raw[self.at[a] : self.at[b]].astype(np.uint64) + np.uint64(1)
                places = self.at[a:b] - first
                out.append(np.add.reduceat(part * _POWERS[: len(part)], places) * _INVERSES[places])
            else:
                b = a + 1
                digest = hashlib.blake2b(self.raw[self.at[a] : self.at[b]], digest_size=8).digest()
                out.append(np.frombuffer(digest, np.uint64))
            a = b
        return _mixed(np.concatenate(out))

    def grams(self, gram: int) -> np.ndarray:
        """A hash of each `gram` words in a row, across texts too; gram is a power of two."""
        h, m = self.hashes(), 1
        while m < gram:
            h = h[: max(0, len(h) - m)] * np.uint64(pow(_BASE, m, 1 << 64)) + h[m:]
            m *= 2
        return _mixed(h)

    def contexts(self, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, minimiser's hash) of each context; windows never cross texts."""
        h = self.grams(gram)
        inside = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - size + 1) for a, b in zip(self.begin[:-1], self.begin[1:], strict=True) if b - a >= size)])
        if not len(inside):
            return inside, inside, np.zeros(0, np.uint64)
        view = sliding_window_view(h, size - gram + 1)
        least = np.concatenate([inside[a : a + WINDOWS] + view[inside[a : a + WINDOWS]].argmin(axis=1) for a in range(0, len(inside), WINDOWS)])
        edge = np.flatnonzero(np.r_[True, (np.diff(inside) != 1) | (np.diff(least) != 0)])
        return inside[edge], np.diff(np.r_[edge, len(inside)]), h[least[edge]]

    def digests(self, first: np.ndarray, words: np.ndarray) -> np.ndarray:
        """128-bit digests, as two integers each, of so many words from each first one."""
        view = memoryview(self.text)
        both = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(self.at[first].tolist(), self.at[first + words].tolist(), strict=True))
        return np.frombuffer(both, np.int64).reshape(-1, 2)

    def rows(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in it) of words."""
        of = np.searchsorted(self.begin, first, side="right") - 1
        return of, first - self.begin[of]


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Texts, their words joined by one space, in blocks; written once, bucketed by block."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        block, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def emit():
            own = pa.concat_arrays(ids)
            lengths, content = pack_bytes(texts)
            cells = [pa.array([block], pa.int64()), pa.array([held], pa.int64()), pa.array([lengths], pa.binary()), pa.array([content], pa.binary())]
            return pa.RecordBatch.from_arrays([*cells, pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], names=["block", "bytes", "lengths", "texts", "ids"])

        for part in sliced(batches):
            ids.append(part.column(0))
            new = [_SPACE.sub(b" ", x).strip(b" ") for x in part.column(1).to_pylist()]
            texts += new
            held += sum(map(len, new))
            if held >= block_bytes:
                yield emit()
                block, ids, texts, held = block + 1, [], [], 0
                released()
        if ids:
            yield emit()

    return bucketed(rows.mapInArrow(run, f"block long, bytes long, lengths binary, texts binary, ids array<{kind}>"), "substring_texts", "block")


_PLACE = "block long, row int, start int, windows int"


def _indexed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The index: for each key its least (id, place) and the number of its rows; null ids come after all others."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "block", "row", "start")).alias("first")
    return rows.groupBy(*keys).agg(first, F.count("*").alias("n"))


#: Whether the index entry's document has a smaller id than the row's.
_EARLIER = "struct(first.none AS none, first.id AS id) < struct(id IS NULL AS none, id AS id)"
_FOUND = ["block", "row", "start", "windows", "first.block AS in_block", "first.row AS in_row", "first.start AS in_start", "first.id AS in_id"]


def _matches(blocks: DataFrame, size: int, gram: int) -> DataFrame:
    """Windows, in runs, whose words also start in a document of a smaller id, each with the first such place."""
    kind = T.StructField("id", blocks.schema["ids"].dataType.elementType)
    place = T._parse_datatype_string(_PLACE)
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    contexts_type, windows_type = T.StructType([*place, *longs("anchor", "c1", "c2"), kind]), T.StructType([*place, *longs("c1", "c2"), kind])

    def contexts(batches):
        for batch in batches:
            for block, lengths, texts, ids in zip(*(batch.column(c).to_pylist() for c in ("block", "lengths", "texts")), batch.column("ids"), strict=True):
                words = Words(unpack_bytes(lengths, texts))
                first, n, anchor = words.contexts(size, gram)
                row, start = words.rows(first)
                digest = words.digests(first, n + size - 1)
                cells = [pa.array(np.full(len(row), block)), pa.array(row.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), ids.values.take(pa.array(row))]
                yield pa.RecordBatch.from_arrays(cells, names=contexts_type.names)
                released()

    known = saved(blocks.select("block", "lengths", "texts", "ids").mapInArrow(contexts, contexts_type), "substring_contexts")
    index = _indexed(known, ["anchor", "c1", "c2"])
    several = index.groupBy("anchor").agg(F.count("*").alias("several")).where("several > 1")
    index = index.join(several, "anchor", "left").withColumn("several", F.col("several").isNotNull()).where("several or n > 1")
    judged = saved(known.join(index, ["anchor", "c1", "c2"]).select("block", "row", "start", "windows", "id", "first", "several", F.expr(_EARLIER).alias("earlier")), "substring_judged")

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty.empty_table()
        words = Words(unpack_bytes(left.column("lengths")[0].as_py(), left.column("texts")[0].as_py()))
        row, start, n = (right.column(c).to_numpy() for c in ("row", "start", "windows"))
        each = np.repeat(np.arange(len(row)), n)
        start = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        digest = words.digests(words.begin[row[each]] + start, np.full(len(each), size))
        ids = right.column("id").combine_chunks().take(pa.array(each))
        cells = [pa.array(np.full(len(each), left.column("block")[0].as_py())), pa.array(row[each].astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(np.ones(len(each), np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), ids]
        return pa.table(cells, names=windows_type.names)

    empty = to_arrow_schema(windows_type)
    edges = judged.where("several and not earlier").select("block", "row", "start", "windows", "id")
    alone = saved(blocks.select("block", "lengths", "texts").groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(tidy_pair(windows), windows_type), "substring_windows")
    found = alone.join(_indexed(alone, ["c1", "c2"]).where("n > 1"), ["c1", "c2"]).where(_EARLIER)
    return judged.where("earlier").selectExpr(*_FOUND).unionByName(found.selectExpr(*_FOUND))


def _factors(row: np.ndarray, start: np.ndarray, end: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by place, where factors begin in it): matches of one text that continue in the same place form a factor.

    source: columns (block, row, shift) of the place that a match stands in.
    """
    order = np.lexsort((start, row))
    row, start, source = row[order], start[order], source[order]
    same = (np.diff(row) == 0) & (start[1:] <= end[order][:-1]) & (np.diff(source, axis=0) == 0).all(axis=1)
    return order, np.flatnonzero(np.r_[True, ~same][: len(order)])


def substring_dedup(docs: DataFrame, size: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """Removes each word covered by a window of `size` words whose sequence also starts in a document of a smaller id.

    Words are what ASCII white space parts, unchanged; windows are judged on the input and never cross texts. Texts are
    written once in blocks and never shuffled; contexts (28 bytes for about 18 words), windows at the boundaries of
    factors, and matches travel. gram: a power of two, at most `size`.

    Returns id_col, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) and, with keep_text, kept and
    factors: (start, length, ref_id, ref_start) in words, what the parse copies from earlier documents, in order; they
    may overlap by less than `size` words. Null texts have no words; texts of fewer words than `size` keep all. Rows of one
    id are not earlier than each other, so repeated rows all stay, unless a smaller id has the words; a null id comes
    after all others. An empty table gives an empty one; other columns are ignored.
    """
    if gram & (gram - 1) or not 0 < gram <= size:
        raise ValueError("gram must be a power of two of at most size")
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    names = ["row", "start", "windows", "in_block", "in_row", "in_start"]

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return None
        words = Words(unpack_bytes(left.column("lengths")[0].as_py(), left.column("texts")[0].as_py()))
        row, start, windows, *source = (right.column(c).to_numpy().astype(np.int64) for c in names)
        begin, end = words.begin[row] + start, words.begin[row] + start + windows + size - 1
        step = np.zeros(len(words.at), np.int64)
        np.add.at(step, begin, 1)
        np.add.at(step, end, -1)
        gone = np.cumsum(step)[: len(words.at) - 1] > 0
        # pieces of a text are runs of kept words
        head = np.zeros(len(gone) + 1, bool)
        head[words.begin] = True
        opens = np.flatnonzero(~gone & (np.r_[True, gone][: len(gone)] | head[:-1]))
        closes = np.flatnonzero(~gone & (np.r_[gone[1:], True][: len(gone)] | head[1:])) + 1
        parts: dict[int, list[bytes]] = {}
        for i, a, b in zip(words.rows(opens)[0].tolist(), words.at[opens].tolist(), words.at[closes].tolist(), strict=True):
            parts.setdefault(i, []).append(words.text[a : b - 1])
        kept = [b" ".join(parts.get(i, ())) for i in range(len(words.n))]
        removed = np.r_[0, np.cumsum(gone)]
        out = [pa.concat_arrays(left.column("ids").chunks).flatten(), pa.array(words.n), pa.array(removed[words.begin[1:]] - removed[words.begin[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        if keep_text:
            order, first = _factors(row, start, start + windows + size - 1, np.stack([source[0], source[1], source[2] - start], axis=1))
            last = np.r_[first[1:], len(order)] - 1
            head = order[first]
            stop = np.maximum.reduceat((start + windows + size - 1)[order], first) if len(first) else last
            cells = [pa.array(start[head]), pa.array(stop - start[head]), right.column("in_id").combine_chunks().take(pa.array(head)), pa.array(source[2][head])]
            edges = np.searchsorted(row[head], np.arange(len(words.n) + 1)).astype(np.int32)
            out += [pa.array([x.decode() for x in kept], pa.string()), pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(cells, names=["start", "length", "ref_id", "ref_start"]))]
        return pa.table(out, names=[id_col, "n_words", "n_removed", "kept_sha256", *(["kept", "factors"] if keep_text else [])])

    schema = f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + f", kept string, factors array<struct<start: long, length: long, ref_id: {kind}, ref_start: long>>" * keep_text
    return blocks.select("block", "ids", "lengths", "texts").groupBy("block").cogroup(_matches(blocks, size, gram).groupBy("block")).applyInArrow(tidy_pair(remove), schema)
