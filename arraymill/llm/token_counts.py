"""Token counts: Arrow functions that encode batches balanced by bytes and return lengths only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WITH_SPACE, WordCache, by_size, cache


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """Counts the tokens of every text with a byte-level BPE of the tokenizers library.

    Texts are cut before white space that follows another character, where the pre-tokenizer always cuts too, so the
    counts of the parts add up to the count of the whole; each part is encoded once per worker while it stays in a
    bounded table. One pass over the scan, no shuffle; a batch holds about batch_bytes bytes of text.

    Returns id_col, n_bytes, n_tokens, over_limit. Null texts count as empty (0, 0, false); null ids, repeated rows
    and ties pass through, one output row per input row; an empty table gives an empty one; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        known = cache("length", tokenizer_path, lambda path: WordCache(path, len))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lengths: list[int] = []
            sizes = pc.binary_length(batch.column(1))
            for a, b in by_size(sizes.to_pylist(), batch_bytes):
                parts = [WITH_SPACE.findall(x) for x in texts[a:b]]
                table = known.table(set().union(*parts))
                lengths += [sum(map(table.__getitem__, x)) for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes.cast(pa.int64()), pa.array(lengths, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    found = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
