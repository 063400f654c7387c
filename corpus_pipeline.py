"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, BPE encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arraymill.llm.bpe import encode_decode
from arraymill.llm.common import new_path
from arraymill.llm.decontamination import decontaminate
from arraymill.llm.exact_dedup import exact_dedup
from arraymill.llm.near_duplicates import near_duplicates
from arraymill.llm.queries import held_out, table, tokenizer_path
from arraymill.llm.toxicity import score_toxicity

#: Not expressible: the first stage is a trained model, and bit sampling by XXH64 is no SQL function of DuckDB.
ORACLE_SQL = None


# Stages decide by row and carry whole rows along: no stage joins by doc_id, so ids may be null or repeated. Null texts
# count as empty everywhere and stay null in what is passed on; very long texts are taken whole; an empty table passes
# through every stage as an empty table; columns are neither read by name, but for doc_id and text, nor changed.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under 0.5; the model learns from the labelled rows of docs, but for a fifth of the ids.

    The score depends on the text alone: equal texts go or stay together, whatever their ids. Rows with null ids are
    scored and not learnt from. Without labels of both classes all rows have the share of label 1 as their score.
    """
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), train_on=~held_out(5, "__id"), carry=True)
    return scored.where("predicted = 0").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, one with the largest doc_id; one of several that tie or are repeated in full.

    A row with a null id stays only where its text has no other id. Null and empty texts are equal.
    """
    return exact_dedup(docs, keep="largest", carry=True).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row of the smallest doc_id: texts whose five-word shingles overlap by 0.8 or more.

    SimHash links and MinHash bands propose pairs, exact overlap decides. Where ids repeat, texts of one id that are no near
    copies of each other are judged each on its own. A row with a null id stays only where its group has no other id.
    Texts without words are near copies of each other.
    """
    return near_duplicates(docs, similarity=0.8, shingle=5, radius=2, seed=42).where("kept").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not contaminated by a benchmark item; texts without words stay, and so does all without items."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=13, share=20, carry=True).where("not contaminated").select("row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For every row its doc_id, number of tokens and digests of ids and decoded text; rows are neither lost nor merged.

    Null ids pass through, repeated rows each get a row, and null texts have no tokens.
    """
    return encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("decontamination", decontamination),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
