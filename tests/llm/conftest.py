import random

import pytest
from pyspark.sql import functions as F

from ..conftest import SF


@pytest.fixture(scope="session")
def docs(spark):
    """Real documents, and odd rows: nulls, empty and blank texts, ties, repeats, a long text, special strings; with
    extra columns whose names clash with those that operators make."""
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma.", "<|endoftext|>", "né", "x" * 300, "it's", "  ", "\n\n", "you", "IDIOT", "日本語"]
    odd = [(10_000 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    odd += [(20_000, None), (20_001, ""), (20_002, " \t\n "), (20_003, "one"), (20_004, "one two"), (20_005, base[0][1]), (20_006, base[0][1]), (20_007, "word " * 30_000), (20_008, "a" * 20_000)]
    odd += [(None, "no id"), (None, None)]
    table = spark.createDataFrame(base + odd, "doc_id long, text string").repartition(3)
    return table.select("*", *[F.lit("clash").alias(c) for c in ("id", "h", "fp", "words", "__text", "features", "block", "bucket", "score", "kept", "n_tokens", "tokens", "label")])


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
