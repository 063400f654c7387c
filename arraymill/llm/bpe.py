"""BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import bucketed, buckets_for, by_bucket, pack, pack_bytes, ragged, ranked, released, sliced, tidy, tidy_pair, unpack, unpack_bytes
from .common import text_bytes
from .tokens import SPACE, tokenizer

_S = "".join(rf"\x{{{ord(c):x}}}" if c != "-" else "-" for c in SPACE)
#: The word pattern of byte-level BPE, with Unicode white space spelled out for the JVM.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
BLOCK_CHARS = 24 << 20
#: Bytes of text for each bucket of words.
WORDS_BYTES = 16 << 20

DOCS = "block long, bucket int, ids array<{kind}>, counts binary, codes binary, lengths binary, words binary"


def split_words(text: Column, special: list[str]) -> Column:
    """The words of a text, as the pre-tokenizer cuts them; each special string is a word of its own.

    special: the strings of added tokens, none or several. Where two of them begin at one place the longer one counts.
    """
    plain = lambda x: F.regexp_extract_all(x, F.lit(WORDS), F.lit(0))
    if not special:
        return plain(text)
    quoted = "|".join("".join(f"\\{c}" if not c.isalnum() else c for c in x) for x in sorted(special, key=len, reverse=True))
    sections, marks = F.split(text, quoted, -1), F.regexp_extract_all(text, F.lit(f"({quoted})"))
    marked = F.transform(sections, lambda x, i: F.when(i == 0, plain(x)).otherwise(F.concat(F.array(F.element_at(marks, F.greatest(i, F.lit(1)))), plain(x))))
    return F.when(F.array_size(marks) > 0, F.flatten(marked)).otherwise(plain(text))


def special_strings(path: str) -> list[str]:
    """The strings of a tokenizer's added tokens."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens") or []]


def pieces(path: str) -> list[bytes]:
    """The id-to-piece table: the bytes of every id of a byte-level BPE."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in kept]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}
    t = tokenizer(path)
    return [bytes(byte_of[c] for c in t.id_to_token(i)) for i in range(t.get_vocab_size(with_added_tokens=True))]


def word_blocks(docs: DataFrame, special: list[str], block_chars: int, id_col: str, text_col: str, words_bytes: int = WORDS_BYTES) -> DataFrame:
    """Texts as rows of codes and dictionary rows, written once, bucketed by block.

    Words go to buckets by hash, one for every words_bytes of text.
    """
    kind, buckets = docs.schema[id_col].dataType.simpleString(), buckets_for(text_bytes(docs, text_col), words_bytes)
    words = docs.select(F.col(id_col).alias("id"), split_words(F.coalesce(F.col(text_col), F.lit("")), special).alias("words"))

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in sliced(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= block_chars:
                yield emit(block, held)
                block, held, size = block + 1, [], 0
                released()
        if held:
            yield emit(block, held)

    def emit(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([b.column(0) for b in held])
        lists = [b.column(1) for b in held]
        counts = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.uint32)
        distinct, codes = ranked(pa.concat_arrays([x.flatten() for x in lists]))
        texts = [w.encode() for w in distinct.to_pylist()]
        rows = {"block": [block], "bucket": [-1], "counts": [pack(counts)], "codes": [pack(codes)], "lengths": [None], "words": [None]}
        for k, mine in by_bucket(texts, buckets):
            lengths, content = pack_bytes([texts[i] for i in mine.tolist()])
            for name, value in (("block", block), ("bucket", k), ("counts", None), ("codes", pack(mine.astype(np.uint32))), ("lengths", lengths), ("words", content)):
                rows[name].append(value)
        n = len(rows["block"])
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["block"], pa.int64()), pa.array(rows["bucket"], pa.int32()), pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * n, pa.int32()), ids), *[pa.array(rows[c], pa.binary()) for c in ("counts", "codes", "lengths", "words")]],
            names=["block", "bucket", "ids", "counts", "codes", "lengths", "words"],
        )

    return bucketed(words.mapInArrow(run, DOCS.format(kind=kind)), "bpe_words", "block")


def encode_words(blocks: DataFrame, tokenizer_path: str) -> DataFrame:
    """Dictionary rows by bucket -> (block, codes, lengths, tokens): each distinct word of a bucket is encoded once.

    A bucket holds the words of its share of hashes from all blocks; the number of buckets follows the bytes of the texts.
    """

    def run(table: pa.Table) -> pa.Table:
        held = [(block, unpack(codes), unpack_bytes(lengths, words)) for block, codes, lengths, words in zip(*(table.column(c).to_pylist() for c in ("block", "codes", "lengths", "words")), strict=True)]
        ids: dict[bytes, bytes] = dict.fromkeys(w for _, _, words in held for w in words)
        distinct = list(ids)
        t = tokenizer(tokenizer_path)
        for a in range(0, len(distinct), 5_000):
            part = distinct[a : a + 5_000]
            for w, e in zip(part, t.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                ids[w] = np.array(e.ids, np.uint32).tobytes()
        rows = []
        for block, codes, words in held:
            found = [ids[w] for w in words]
            sizes = np.fromiter(map(len, found), np.uint32, len(found)) // np.uint32(4)
            rows.append((block, pack(codes), pack(sizes), pack(np.frombuffer(b"".join(found), np.uint32))))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(("codes", "sizes", "tokens"), 1)}})

    return blocks.where("bucket >= 0").select("bucket", "block", "codes", "lengths", "words").groupBy("bucket").applyInArrow(tidy(run), "block long, codes binary, sizes binary, tokens binary")


class Lexicon:
    """The token ids of every code of a block."""

    def __init__(self, table: pa.Table):
        parts = [(unpack(c), unpack(s), unpack(t)) for c, s, t in zip(*(table.column(n).to_pylist() for n in ("codes", "sizes", "tokens")), strict=True)]
        codes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint32)
        sizes = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        starts = np.cumsum(sizes) - sizes
        self.tokens = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint32)
        self.start, self.size = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        self.start[codes], self.size[codes] = starts, sizes

    def ids(self, codes: np.ndarray) -> np.ndarray:
        return self.tokens[ragged(self.start[codes], self.size[codes])]


def _join(blocks: DataFrame, found: DataFrame, use, schema: str) -> DataFrame:
    """use(ids, counts, codes, Lexicon) -> tables, for each block; only what was found is shuffled."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return None
        row = left.slice(0, 1)
        ids = pa.concat_arrays([c for c in row.column("ids").chunks]).flatten()
        return use(ids, unpack(row.column("counts")[0].as_py()), unpack(row.column("codes")[0].as_py()), Lexicon(right))

    docs = blocks.where("bucket = -1").select("block", "ids", "counts", "codes")
    return docs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(tidy_pair(run), schema)


def _documents(counts: np.ndarray, codes: np.ndarray, lexicon: Lexicon, most: int = 200_000):
    """Token ids and document ends for runs of documents of about `most` words."""
    ends = np.cumsum(counts, dtype=np.int64)
    at = 0
    while at < len(counts):
        first = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, first + most, side="right")))
        part = codes[first : int(ends[upto - 1])]
        tokens = lexicon.ids(part)
        sizes = np.r_[0, np.cumsum(lexicon.size[part])]
        yield at, upto, tokens, sizes[np.r_[0, ends[at:upto] - first]]
        at = upto


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id_col, tokens array<int> of every text; see encode_decode for the method and the treatment of odd rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def use(ids, counts, codes, lexicon):
        lists = [x.tolist() for _, _, tokens, cut in _documents(counts, codes, lexicon) for x in np.split(tokens.astype(np.int32), cut[1:-1])]
        return pa.table({id_col: ids, "tokens": pa.array(lists, pa.list_(pa.int32()))})

    blocks = word_blocks(docs, special_strings(tokenizer_path), block_chars, id_col, text_col)
    return _join(blocks, encode_words(blocks, tokenizer_path), use, f"`{id_col}` {kind}, tokens array<int>")


def decode(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """id_col, decoded: ids joined with the id-to-piece table (its size is that of the vocabulary), pieces concatenated.

    Bytes that are no UTF-8 become replacement characters, null lists empty texts; unknown ids raise an error.
    """
    kind = tokens.schema[id_col].dataType.simpleString()
    table = pieces(tokenizer_path)

    def run(batches):
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return tokens.select(id_col, F.coalesce(F.col(tokens_col), F.array().cast("array<int>")).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encodes and decodes every whole text with a byte-level BPE, by a table of distinct words.

    Spark splits the texts into words; a block of documents (about block_chars of words) keeps the codes of its words
    by position and a dictionary. Dictionary rows are shuffled by word bucket, each distinct word is encoded once, and
    its ids return to the blocks, which were written bucketed and are not shuffled. Ids are decoded by a join with the
    id-to-piece table.

    Returns id_col, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256. Null texts count as empty
    (no tokens); null ids pass through; repeated rows each get a row; an empty table gives an empty one; other columns
    are ignored. Special strings in a text become their token, as is the library's default.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def use(ids, counts, codes, lexicon):
        piece = pa.array(pieces_cached(tokenizer_path), pa.binary())
        decimal = np.array([b"%d," % i for i in range(len(piece))], object)
        n, ids_sha, text_sha = [], [], []
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for _, _, tokens, cut in _documents(counts, codes, lexicon):
            n.append(np.diff(cut))
            joined = piece.take(pa.array(tokens))
            place = joined.offsets.to_numpy()[cut] if hasattr(joined, "offsets") else np.frombuffer(joined.buffers()[1], np.int32)[cut + joined.offset]
            raw = memoryview(joined.buffers()[2] or b"")
            texts = decimal[tokens].tolist()
            for a, b, x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), place[:-1].tolist(), place[1:].tolist(), strict=True):
                ids_sha.append(sha(b"".join(texts[a:b])[:-1]))
                text_sha.append(sha(bytes(raw[x:y]).decode("utf-8", "replace").encode()))
        return pa.table({id_col: ids, "n_tokens": pa.array(np.concatenate(n) if n else [], pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    blocks = word_blocks(docs, special_strings(tokenizer_path), block_chars, id_col, text_col)
    return _join(blocks, encode_words(blocks, tokenizer_path), use, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


_pieces: dict[str, list[bytes]] = {}


def pieces_cached(path: str) -> list[bytes]:
    if path not in _pieces:
        _pieces[path] = pieces(path)
    return _pieces[path]
