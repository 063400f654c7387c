"""LM scoring: a weighted backoff automaton of smoothed n-grams, traversed once from left to right."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import bucketed, buckets_for, by_bucket, key_ranges, pack, pack_bytes, ranked, released, sliced, tidy, tidy_pair, unpack, unpack_bytes
from .common import partitions, text_bytes

BLOCK_BYTES = 8 << 20
#: Bytes of text for each range of n-gram keys and each bucket of words.
RANGE_BYTES = 16 << 20
#: Bits of an n-gram's key. Two n-grams share one with a chance of about (number of n-grams) / 2 ** 56.
KEY_BITS = 56
BINS, RATIOS, RATIO_LOW = 40, 64, -16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BEGIN, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs (a, b), order kept."""
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD) + b * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _blocks(docs: DataFrame, train: Column, id_col: str, text_col: str, block_bytes: int, buckets: int) -> DataFrame:
    """Texts as rows of codes and dictionary rows with counts in training texts, written once, bucketed by block."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in sliced(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= block_bytes:
                yield emit(block, held)
                block, held, size = block + 1, [], 0
                released()
        if held:
            yield emit(block, held)

    def emit(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([b.column(0) for b in held])
        flags = np.array([x for b in held for x in b.column(1).to_pylist()], np.uint8)
        counts, words = [], []
        for b in held:
            for text in b.column(2).to_pylist():
                found = tokens_of(text)
                counts.append(len(found))
                words.extend(found)
        counts = np.array(counts, np.uint32)
        distinct, codes = ranked(pa.array(words, pa.binary()))
        del words
        seen = np.bincount(codes[np.repeat(flags, counts) > 0], minlength=len(distinct)).astype(np.uint32)
        texts = distinct.to_pylist()
        rows = [(block, -1, pack(flags), pack(counts), pack(codes), None, None)]
        for k, mine in by_bucket(texts, buckets):
            lengths, content = pack_bytes([texts[i] for i in mine.tolist()])
            rows.append((block, k, None, pack(seen[mine]), pack(mine.astype(np.uint32)), lengths, content))
        own = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(rows), pa.int32()), ids)
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)]
        return pa.RecordBatch.from_arrays([*cols[:2], own, *cols[2:]], names=["block", "bucket", "ids", "flags", "counts", "codes", "lengths", "words"])

    schema = f"block long, bucket int, ids array<{kind}>, flags binary, counts binary, codes binary, lengths binary, words binary"
    return bucketed(rows.mapInArrow(run, schema), "lm_blocks", "block")


_FOUND = "block long, order int, bucket int, codes binary, counts binary, distinct long, total long"


def _found(rows: list[tuple]) -> pa.Table:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    names = ["block", "order", "bucket", "codes", "counts", "distinct", "total"]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _words(blocks: DataFrame) -> DataFrame:
    """Counts of every word over all training texts, summed by bucket and returned to the blocks by code."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        held = [(b, codes, unpack(counts), unpack_bytes(lengths, words)) for b, codes, counts, lengths, words in zip(*(table.column(c).to_pylist() for c in ("block", "codes", "counts", "lengths", "words")), strict=True)]
        coded = pa.array([w for h in held for w in h[3]], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        total = np.bincount(coded, weights=np.concatenate([h[2] for h in held])).astype(np.uint64)
        rows, at = [], 0
        for i, (block, codes, counts, _) in enumerate(held):
            rows.append((block, 1, bucket, codes, pack(total[coded[at : at + len(counts)]]), int((total > 0).sum()) if i == 0 else 0, int(total.sum()) if i == 0 else 0))
            at += len(counts)
        return _found(rows)

    return blocks.where("bucket >= 0").select("bucket", "block", "codes", "counts", "lengths", "words").groupBy("bucket").applyInArrow(tidy(run), _FOUND)


class Block:
    """The n-grams of a block's texts: for each order the sorted distinct keys, and the n-gram at each position."""

    def __init__(self, table: pa.Table, order: int):
        rows = {c: table.column(c).to_pylist() for c in ("bucket", "flags", "counts", "codes", "lengths", "words")}
        head = rows["bucket"].index(-1)
        self.ids = pa.concat_arrays(table.column("ids").chunks)
        self.ids = self.ids.slice(head, 1).flatten()
        self.flags, counts, codes = unpack(rows["flags"][head]), unpack(rows["counts"][head]).astype(np.int64), unpack(rows["codes"][head])
        dictionary = [(unpack(rows["codes"][i]), unpack_bytes(rows["lengths"][i], rows["words"][i])) for i, b in enumerate(rows["bucket"]) if b >= 0]
        self.words = sum(len(w) for _, w in dictionary)
        hashes = np.empty(self.words + 2, np.uint64)
        for c, w in dictionary:
            hashes[c] = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
        self.end, self.begin = self.words, self.words + 1
        hashes[self.end], hashes[self.begin] = _END, _BEGIN
        # begin, words, end of every text
        self.sizes = counts + 2
        self.first = np.cumsum(self.sizes) - self.sizes
        self.text = np.empty(int(self.sizes.sum()), np.uint32)
        inner = np.ones(len(self.text), bool)
        inner[self.first] = inner[self.first + self.sizes - 1] = False
        self.text[self.first], self.text[self.first + self.sizes - 1] = self.begin, self.end
        self.text[inner] = codes
        trained = np.repeat(self.flags > 0, self.sizes)
        place = np.arange(len(self.text)) - np.repeat(self.first, self.sizes)
        self.keys: list[np.ndarray] = []
        self.seen: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.where: list[np.ndarray] = []
        rolled = hashes[self.text]
        for n in range(2, order + 1):
            shifted = np.empty_like(rolled)
            shifted[0], shifted[1:] = 0, rolled[:-1]
            rolled = mixed(shifted, hashes[self.text])
            real = np.flatnonzero(place >= n - 1)
            keys = rolled[real] >> np.uint64(64 - KEY_BITS)
            order_ = np.argsort(keys, kind="stable").astype(np.uint32)
            keys = keys[order_]
            new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
            number = np.cumsum(new, dtype=np.int32) - 1
            at = np.full(len(self.text), -1, np.int32)
            at[real[order_]] = number
            self.keys.append(keys[new])
            self.where.append(real[order_][new])
            self.at.append(at)
            self.seen.append(np.bincount(number, weights=trained[real[order_]], minlength=int(new.sum())).astype(np.uint32))


def _grams(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """Counts of every n-gram over all training texts: keys go by range to a task that sums them, counts come back."""

    def send(table: pa.Table) -> pa.Table:
        block, rows = Block(table, order), []
        name = table.column("block")[0].as_py()
        for n, keys, seen in zip(range(2, order + 1), block.keys, block.seen, strict=True):
            for k, a, b in key_ranges(keys, KEY_BITS, buckets):
                rows.append((name, n, k, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(seen[a:b]), 0, 0))
        return _found(rows)

    def add(table: pa.Table) -> pa.Table:
        held = [(b, np.cumsum(unpack(codes), dtype=np.uint64), unpack(counts)) for b, codes, counts in zip(*(table.column(c).to_pylist() for c in ("block", "codes", "counts")), strict=True)]
        distinct, number = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
        total = np.bincount(number, weights=np.concatenate([h[2] for h in held]), minlength=len(distinct)).astype(np.uint64)
        n, bucket = table.column("order")[0].as_py(), table.column("bucket")[0].as_py()
        rows, at = [], 0
        for block, keys, _ in held:
            rows.append((block, n, bucket, None, pack(total[number[at : at + len(keys)]]), 0, 0))
            at += len(keys)
        return _found(rows)

    return blocks.groupBy("block").applyInArrow(tidy(send), _FOUND).groupBy("order", "bucket").applyInArrow(tidy(add), _FOUND)


class Counts:
    """Corpus counts of the words (end and begin included) and n-grams of a block, in the block's numbering."""

    def __init__(self, block: Block, found: pa.Table, texts: int, order: int):
        rows = sorted(zip(*(found.column(c).to_pylist() for c in ("order", "bucket", "codes", "counts")), strict=True), key=lambda r: r[:2])
        self.of = [np.full(block.words + 2, texts, np.int64)]
        for n, _, codes, counts in rows:
            if n == 1:
                self.of[0][unpack(codes)] = unpack(counts)
        for n in range(2, order + 1):
            parts = [unpack(counts) for m, _, _, counts in rows if m == n]
            self.of.append(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))


class Model:
    """Interpolated n-gram probabilities: base add-0.1 unigrams, and weight[order, log2 of the context's count] above."""

    def __init__(self, total: int, distinct: int, weight: np.ndarray):
        self.total, self.distinct, self.weight = total, distinct, weight

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def of(self, n: int, context: np.ndarray) -> np.ndarray:
        return self.weight[n, _bin(context)]


def _bin(count: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(count, 1))[1] - 1


class Automaton:
    """States are contexts with training counts: the empty one, words, and n-grams. Arcs are n-grams with counts.

    An arc's weight is the log10 probability of its last word in its context, its target the longest state that ends
    in it; a failure arc leads to the context without its first word and weighs log10 of the mass left to it.
    """

    def __init__(self, block: Block, counts: Counts, model: Model, order: int):
        self.block, self.order = block, order
        self.start = 1 + block.begin if order > 1 and counts.of[0][block.begin] > 0 else 0
        sizes = [len(c) for c in counts.of]
        self.base = [0, *np.cumsum(sizes).tolist()]  # arc numbers of order n begin at base[n - 1]; state numbers are 1 + them
        p = [model.base(counts.of[0])]
        known = [counts.of[0] > 0]
        lower_arc, context, with_context = [], [], []
        for n in range(2, order + 1):
            place, count = block.where[n - 2], counts.of[n - 1]
            here = block.text[place] if n == 2 else block.at[n - 3][place]
            before = block.text[place - 1] if n == 2 else block.at[n - 3][place - 1]
            seen = counts.of[n - 2][before]
            share = model.of(n, seen)
            p.append(share * count / np.maximum(seen, 1) + (1 - share) * p[n - 2][here])
            known.append(count > 0)
            lower_arc.append(here)
            context.append(before)
            with_context.append(seen)
        self.weight = np.full(self.base[-1], np.nan)
        self.next = np.zeros(self.base[-1], np.int64)
        self.fail_weight = np.zeros(1 + self.base[-1])
        self.fail = np.zeros(1 + self.base[-1], np.int64)
        self.level = np.zeros(1 + self.base[-1], np.int8)
        for n in range(1, order + 1):
            arcs = slice(self.base[n - 1], self.base[n])
            states = slice(1 + self.base[n - 1], 1 + self.base[n])
            self.weight[arcs] = np.log10(p[n - 1]) if n == 1 else np.where(known[n - 1], np.log10(p[n - 1]), np.nan)
            top = n == order  # the longest n-grams are no contexts: their arcs lead to the state without the first word
            shorter = np.zeros(sizes[0], np.int64) if n == 1 else 1 + self.base[n - 2] + lower_arc[n - 2].astype(np.int64)
            own = np.arange(self.base[n - 1], self.base[n]) + 1
            self.next[arcs] = (shorter if top else np.where(known[n - 1], own, 0)) if n > 1 else np.where(known[0], own, 0)
            if not top:
                self.level[states] = n
                self.fail[states] = shorter
                self.fail_weight[states] = np.log10(1 - model.of(n + 1, counts.of[n - 1]))

    def scores(self) -> np.ndarray:
        """log10 probability of every text: all texts of the block advance together, one token a step."""
        b = self.block
        longest_first = np.argsort(-b.sizes, kind="stable")
        at = b.first[longest_first] + 1
        left = np.searchsorted(-b.sizes[longest_first], -np.arange(2, int(b.sizes.max(initial=1)) + 1), side="right")
        total = np.zeros(len(at))
        state = np.full(len(at), self.start)
        for active in left.tolist():
            place, s, sum_ = at[:active], state[:active], total[:active]
            arc = np.full(active, -1)
            for n in range(self.order - 1, 0, -1):
                try_ = np.flatnonzero((self.level[s] == n) & (arc < 0))
                if not len(try_):
                    continue
                number = self.base[n] + b.at[n - 1][place[try_]]
                good = ~np.isnan(self.weight[number])
                arc[try_[good]] = number[good]
                lost = try_[~good]
                sum_[lost] += self.fail_weight[s[lost]]
                s[lost] = self.fail[s[lost]]
            rest = np.flatnonzero(arc < 0)
            arc[rest] = b.text[place[rest]]
            sum_ += self.weight[arc]
            s[:] = self.next[arc]
            place += 1
        out = np.empty(len(at))
        out[longest_first] = total
        return out


def _statistics(block: Block, counts: Counts, model: Model, order: int) -> pa.Table:
    """Histogram over training tokens of log2 (left-one-out n-gram estimate / lower estimate), by order and context bin."""
    rows = []
    trained = np.repeat(block.flags > 0, block.sizes)
    lower = model.base(counts.of[0])[block.text]
    for n in range(2, order + 1):
        place = np.flatnonzero((block.at[n - 2] >= 0) & trained)
        number = block.at[n - 2][place]
        before = block.text[place - 1] if n == 2 else block.at[n - 3][place - 1]
        count, seen = counts.of[n - 1][number], counts.of[n - 2][before]
        left_out = (count - 1) / np.maximum(seen - 1, 1)
        with np.errstate(divide="ignore"):
            ratio = np.where(count > 1, np.clip(np.floor(np.log2(left_out / lower[place])) - RATIO_LOW, 1, RATIOS - 1), 0).astype(np.int64)
        cells = np.bincount(_bin(seen) * RATIOS + ratio, minlength=BINS * RATIOS)
        rows += [(n, int(i) // RATIOS, int(i) % RATIOS, int(cells[i])) for i in np.flatnonzero(cells)]
        estimate = np.zeros(len(block.text))
        estimate[place] = 0.5 * count / np.maximum(seen, 1)
        lower = estimate + 0.5 * lower
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["order", "bin", "ratio", "n"])


def weights(cells: list[tuple[int, int, int, int]], order: int, rounds: int = 40) -> np.ndarray:
    """Expectation maximisation of the share of each order and context bin over the histogram of left-one-out ratios."""
    out = np.full((order + 1, BINS), 0.5)
    value = np.r_[0.0, 2.0 ** (np.arange(1, RATIOS) + RATIO_LOW + 0.5)]
    table = np.zeros((order + 1, BINS, RATIOS))
    for n, b, r, count in cells:
        table[n, b, r] += count
    for n in range(2, order + 1):
        for b in range(BINS):
            mass = table[n, b].sum()
            if mass:
                for _ in range(rounds):
                    w = out[n, b]
                    out[n, b] = (table[n, b] * w * value / (w * value + 1 - w)).sum() / mass
            elif b:
                out[n, b] = out[n, b - 1]
        out[n, 0] = out[n, 1]  # a context seen once says nothing about itself when that one is left out
    return np.clip(out, 0.001, 0.98)


def lm_scores(docs: DataFrame, train: Column, order: int = 3, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Scores every whole text with an n-gram model of all texts for which `train` holds.

    Blocks of texts are written once as codes, bucketed by block. Distinct words and n-grams of each block are shuffled
    with their counts to the task of their key range, summed over the corpus, and the sums return to the blocks; the
    automaton of a block holds the states and arcs its texts can reach, and one traversal carries each text's state.
    The shares of the orders are fitted by left-one-out expectation maximisation over all training tokens. No task and
    no driver holds the model: what a task gets is its key range, one for every range_bytes of text, or what its block can reach.

    Returns id_col, n_tokens (end included), n_known, train_tokens, base_score (add-0.1 unigrams), score (log10). Null
    texts count as empty (one token, the end); null ids pass through; a null `train` counts as false; repeated rows each
    get a row and count as often; an empty table gives an empty one, and without training texts all words are unknown.
    Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = buckets_for(text_bytes(docs, text_col), range_bytes)
    blocks = _blocks(docs, train, id_col, text_col, block_bytes, buckets)
    spark = docs.sparkSession
    found = _words(blocks)
    if order > 1:
        found = found.unionByName(_grams(blocks, order, buckets))
    found = bucketed(found.repartition(partitions(spark), "block"), "lm_counts", "block")
    distinct, total = found.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def flags(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(unpack(x).sum()) for x in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    texts = blocks.where("bucket = -1").select("flags").mapInArrow(flags, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = total + texts, distinct + (texts > 0)
    rows, sums = blocks.groupBy("block"), found.groupBy("block")

    def statistics(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, order)
        return _statistics(block, Counts(block, right, texts, order), Model(total, distinct, np.zeros((order + 1, BINS))), order)

    cells = rows.cogroup(sums).applyInArrow(tidy_pair(statistics), "order int, bin int, ratio int, n long").groupBy("order", "bin", "ratio").agg(F.sum("n").alias("n"))
    model = Model(total, distinct, weights([tuple(r) for r in cells.collect()], order))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, order)
        counts = Counts(block, right, texts, order)
        log = np.log10(model.base(counts.of[0]))
        log[block.begin] = 0.0
        known = counts.of[0] > 0
        known[block.begin] = False
        add = lambda x: np.add.reduceat(x[block.text], block.first) if len(block.first) else np.zeros(0)
        n = len(block.first)
        return pa.table({
            id_col: block.ids, "n_tokens": pa.array(block.sizes - 1), "n_known": pa.array(add(known.astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(n, total), pa.int64()),
            "base_score": pa.array(add(log), pa.float64()), "score": pa.array(Automaton(block, counts, model, order).scores()),
        })

    return rows.cogroup(sums).applyInArrow(tidy_pair(score), f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
