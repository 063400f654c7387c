"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, verified word by word."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import sliced
from .common import saved

#: Bytes of words after lower-casing A-Z; every other ASCII byte separates.
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b >= 128 or b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def item_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD_PATTERN), F.lit(0))


class WindowIndex:
    """Items' words, and for each window the position of its rarest word: the prefix a document must share with it.

    Equal windows of an item count once, so repeated words make no more entries than there are different windows.
    Neighbouring windows with one rarest word are one entry: (item, place of the word, words before it, words from it on).
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], seen_in: dict[bytes, int], window: int):
        self.items, self.window = items, window
        self.prefix: dict[bytes, list[tuple[int, int, int, int]]] = {}
        for k, (_, words) in enumerate(items):
            size = min(window, len(words))
            if not size:
                continue
            rarity = [(seen_in.get(w, 0), w) for w in words]
            known, entry = set(), None
            for s in range(len(words) - size + 1):
                held = tuple(words[s : s + size])
                if held in known:
                    entry = None
                    continue
                known.add(held)
                p = min(range(s, s + size), key=rarity.__getitem__)
                if entry and entry[0] == p:
                    entry[2] = s + size - p
                else:
                    entry = [p, p - s, s + size - p]
                    self.prefix.setdefault(words[p], []).append((k, entry))
        self.prefix = {w: [(k, *e) for k, e in es] for w, es in self.prefix.items()}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs [a, b) of words inside occurring windows, and the ids of their items.

        An alignment compares at most the words of its entry's windows, fewer than two windows' length.
        """
        runs, ids = set(), set()
        if self.prefix.keys().isdisjoint(words):
            return [], ids
        n = len(words)
        for i, w in enumerate(words):
            for k, p, before, after in self.prefix.get(w, ()):
                name, item = self.items[k]
                size = min(self.window, len(item))
                # length and position bounds: the window must fit in what lies left and right of this alignment
                before, after = min(before, i), min(after, n - i)
                if before + after < size:
                    continue
                a = 0
                while a < before and words[i - a - 1] == item[p - a - 1]:
                    a += 1
                b = 1
                while b < after and words[i + b] == item[p + b]:
                    b += 1
                if a + b >= size:
                    runs.add((i - a, i + b))
                    ids.add(name)
        ids.discard(None)
        return sorted(runs), ids


def covered(runs) -> int:
    total = end = 0
    for a, b in sorted(runs):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _blocks(items: DataFrame, most_words: int):
    """The items in blocks of about most_words words: one block unless the benchmark is larger than that."""
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-total // most_words))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k)
        yield n, [(r["id"], [w.encode() for w in r["words"]]) for r in part.collect()]


def _rarity(docs: DataFrame, items: list) -> dict[bytes, int]:
    """Documents, over all of docs, that hold each word of the items; summed in the tasks first."""
    vocabulary = {w for _, words in items for w in words}

    def count(batches):
        seen: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in vocabulary.intersection(words_of(text)):
                    seen[w] = seen.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in found.collect()}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_words: int = 2_000_000, carry: bool = False) -> DataFrame:
    """Marks the document words inside occurrences of benchmark windows of `window` words (shorter items: the whole item).

    All words of a window must be in a document, so its prefix is one word: the rarest by document frequency over all
    documents. Documents probe the index of prefix words; an alignment passes the length and position bounds, then
    words are compared left and right of it, and every full window inside the equal run occurs exactly. The index of a
    benchmark of up to most_words words goes to the tasks as one bounded table; a larger benchmark is taken in blocks
    of that size, hits are written after each block and merged by row.

    Returns id_col, n_words, n_hit, n_items, items_sha256 (of the sorted item ids, comma-joined), contaminated
    (n_hit > 0 and share * n_hit >= n_words) and, with carry, the input row as struct `row`. Null texts have no words; null
    ids pass through; items without words match nothing; items with a null id mark words but are not named; repeated items count once, repeated rows each get
    a row. Empty tables: no rows, or nothing hit. Other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), item_words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0).distinct()
    carried = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"), *carried)
    more = ["row"] if carry else []

    def scan(index: WindowIndex, keys: DataFrame):
        """keys: the columns before the text."""
        names, before, whole = [*keys.columns, "n_words", "runs", "ids"], len(keys.columns), n == 1

        def run(batches):
            for batch in sliced(batches):
                sizes, runs, ids = [], [], []
                for text in batch.column(before).to_pylist():
                    words = words_of(text)
                    r, i = index.hits(words)
                    sizes.append(len(words))
                    runs.append(covered(r) if whole else [x for ab in r for x in ab])
                    ids.append(sorted(i))
                found = [pa.array(sizes, pa.int64()), pa.array(runs, pa.int64() if whole else pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:before], *found], names=names)

        kind = T.LongType() if whole else T.ArrayType(T.LongType())
        return run, T.StructType([*keys.schema, T.StructField("n_words", T.LongType()), T.StructField("runs", kind), T.StructField("ids", T.ArrayType(T.StringType()))])

    found = None
    for n, block in _blocks(items, most_words):
        if n > 1 and found is None:
            texts = saved(texts.withColumn("__key", F.monotonically_increasing_id()), "decontaminate-texts")
        keys = texts.select("id", *more) if n == 1 else texts.select("__key")
        run, schema = scan(WindowIndex(block, _rarity(texts, block), window), keys)
        part = texts.select(*keys.columns, "text").mapInArrow(run, schema)
        if n > 1:
            part = saved(part, "decontaminate-hits")
        found = part if found is None else found.unionByName(part)
    if n > 1:
        merged = found.groupBy("__key").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))

        def add(batches):
            for batch in batches:
                yield batch.set_column(2, "n_hit", pa.array([covered(zip(r[::2], r[1::2], strict=True)) for r in batch.column(2).to_pylist()], pa.int64()))

        merged = merged.select("__key", "n_words", "runs", "ids").mapInArrow(add, "__key long, n_words long, n_hit long, ids array<string>")
        found = texts.select("id", "__key", *more).join(merged, "__key").withColumnRenamed("n_hit", "runs")
    digest = F.sha2(F.array_join("ids", ","), 256)
    out = found.select(F.col("id").alias(id_col), "n_words", F.col("runs").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), digest.alias("items_sha256"), *more)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
