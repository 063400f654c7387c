"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import sliced
from .common import saved

#: A base lexicon of insults, and second-person words.
INSULTS = frozenset("""
idiot idiots idiotic moron morons moronic stupid dumb fool fools loser losers clown clowns pathetic worthless useless
disgusting scum trash garbage filth vermin imbecile cretin jerk creep coward liar hate ugly freak pig rat ignorant
dummkopf trottel abschaum versager dreck widerlich blöd crétin imbécile ordure minable raclure débile estúpido idiota
basura inútil imbécil escoria patético asqueroso
""".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous ton ta tes votre vos du dich dir ihr euch dein deine euer tú ti usted ustedes vosotros tus".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$!*|#][0-9@$!*|#]?[^\W\d_]+")
_RUNS = re.compile(r"[!?*#$%&]{2,}")
_LONG = re.compile(r"([^\W\d_])\1\1")
_CAPS = re.compile(r"\b[A-Z]{3,}\b")
_STEMS = (4, 5, 6)

FEATURES = (
    "insult_density", "insult_hits", "learned_density", "learned_hits", "broad_density", "broad_hits", "top_weight", "second_person",
    "near_second_person", "nearest_second_person", "upper_rate", "caps_words", "exclaim_rate", "question_rate", "punctuation_rate",
    "punctuation_runs", "mixed_words", "hidden_insults", "long_letters", "digit_rate", "log_words", "word_length",
)


def terms_of(text: str | None) -> set[str]:
    """Distinct words of a text, and their stems of 4 to 6 letters marked by a final *."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {f"{w[:k]}*" for w in words for k in _STEMS if len(w) > k}


def features_of(text: str | None, lexicon: dict[str, float], sure: float) -> list[float]:
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n, chars = max(1, len(words)), max(1, len(text))
    have = set(words)
    insults = have & INSULTS
    weight: dict[str, float] = {}
    for w in have:
        best = max((lexicon[x] for x in (w, f"{w[:4]}*", f"{w[:5]}*", f"{w[:6]}*") if x in lexicon), default=0.0)
        if best:
            weight[w] = best
    strong = {w for w, v in weight.items() if v >= sure}
    bad = insults | strong
    you = have & SECOND_PERSON
    hits = dict.fromkeys(bad | weight.keys(), 0)
    near = total = 0
    nearest = 0.0
    if hits:
        at = [(i, w) for i, w in enumerate(words) if w in hits]
        for _, w in at:
            hits[w] += 1
        spots = [i for i, w in at if w in bad]
        total = len(spots)
        if you and spots:
            yous = np.array([i for i, w in enumerate(words) if w in you])
            s = np.array(spots)
            j = np.searchsorted(yous, s)
            gap = np.minimum(np.abs(s - yous[np.minimum(j, len(yous) - 1)]), np.abs(s - yous[np.maximum(j - 1, 0)]))
            near, nearest = int((gap <= 6).sum()), 1.0 / (1.0 + float(gap.min()))
    ascii_counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    digits = int(ascii_counts[48:58].sum())
    letters = int(ascii_counts[65:91].sum()) + int(ascii_counts[97:123].sum())
    punctuation = int(ascii_counts[33:48].sum() + ascii_counts[58:65].sum() + ascii_counts[91:97].sum() + ascii_counts[123:127].sum())
    mixed = _MIXED.findall(low)
    hidden = sum(m.translate(_LEET) in INSULTS or m.replace("*", "") in INSULTS for m in mixed)
    n_insult, n_strong, n_broad = sum(hits[w] for w in insults), sum(hits[w] for w in strong), sum(hits[w] for w in weight)
    return [
        n_insult / n, math.log1p(n_insult), n_strong / n, math.log1p(n_strong), n_broad / n, math.log1p(n_broad), max(weight.values(), default=0.0),
        sum(words.count(w) for w in you) / n, near / max(1, total), nearest, int(ascii_counts[65:91].sum()) / max(1, letters), len(_CAPS.findall(text)) / n,
        int(ascii_counts[33]) / chars, int(ascii_counts[63]) / chars, punctuation / chars, len(_RUNS.findall(text)) / n, len(mixed) / n, hidden / n,
        len(_LONG.findall(low)) / n, digits / chars, math.log1p(len(words)), sum(map(len, words)) / n,
    ]


def _featured(df: DataFrame, lexicon: dict[str, float], sure: float) -> DataFrame:
    """df (key columns, then text) with the text replaced by its features."""
    keys = df.columns[:-1]

    def run(batches):
        for batch in sliced(batches):
            rows = [features_of(x, lexicon, sure) for x in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], pa.array(rows, pa.list_(pa.float64()))], names=[*keys, "features"])

    return df.mapInArrow(run, T.StructType([*df.schema[:-1], T.StructField("features", T.ArrayType(T.DoubleType()))]))


def _counts(df: DataFrame, wanted: frozenset | None) -> DataFrame:
    """Rows of df (text) that hold each term, or each wanted term; summed in the tasks first."""

    def run(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                terms = terms_of(text)
                for t in terms if wanted is None else terms & wanted:
                    seen[t] = seen.get(t, 0) + 1
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
                seen = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return df.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame, size: int = 20_000) -> dict[str, float]:
    """Terms that mark class 1, with their log odds: at most `size`, the most frequent candidates among class 1 rows."""
    n1, n0 = sample.where("label = 1").count(), sample.where("label = 0").count()
    least = max(3, round(0.004 * n1))
    one = {r["term"]: r["n"] for r in _counts(sample.where("label = 1"), None).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(size).collect()}
    zero = {r["term"]: r["n"] for r in _counts(sample.where("label = 0"), frozenset(one)).collect()}
    odds = {t: math.log((n + 0.5) / (n1 + 1)) - math.log((zero.get(t, 0) + 0.5) / (n0 + 1)) for t, n in one.items()}
    return {t: v for t, v in odds.items() if v >= 1.5}


def score_toxicity(docs: DataFrame, labels: DataFrame, train_on: Column, most_labelled: int = 40_000, trees: int = 24, depth: int = 4, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 7, carry: bool = False) -> DataFrame:
    """Scores every whole text with boosted trees over FEATURES, calibrated by isotonic regression.

    Fitted on at most about most_labelled labelled rows for which train_on holds, chosen by a hash of the id: half of
    them teach the lexicon of words and stems that mark label 1, a third the trees, the rest the calibration. Features
    come from Arrow batches over the scan; trees and calibration are applied by Spark ML in the JVM. No shuffle of texts.

    The lexicon has at most 20,000 terms, see learn_lexicon; no other part of the model is capped.

    Returns id_col, score (0 to 1), predicted (1 where score >= threshold) and, with carry, the input row as struct `row`.
    Null texts count as empty and get a score; rows with null ids are scored and never trained on; null labels are
    ignored; an id with several labels has the largest; repeated rows each get a row; if the labelled rows have only one
    class, or there are none, every score is the share of label 1 (0 without labels). Other columns are ignored. An empty
    table gives an empty one.
    """
    carried = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    texts = docs.select(docs[id_col].alias("__id"), *carried, F.coalesce(docs[text_col], F.lit("")).alias("text"))
    more = ["row"] if carry else []
    marked = labels.select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("double").alias("label")).where("label is not null and __id is not null").groupBy("__id").agg(F.max("label").alias("label"))
    hashed = F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(1_000_000))
    chosen = marked.where(train_on).withColumn("h", hashed)
    n = chosen.count()
    if n > most_labelled:
        chosen = chosen.where(F.col("h") < int(1_000_000 * most_labelled / n))
    # about most_labelled ids at most, so they are broadcast and no text is shuffled
    sample = saved(texts.select("__id", "text").join(F.broadcast(chosen.select("__id", "label")), "__id").select("label", F.pmod(F.xxhash64(F.lit(seed + 1), "__id"), F.lit(6)).alias("fold"), "text"), "toxicity-sample")
    seen = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        share = float(next(iter(seen), 0.0))
        return texts.select(F.col("__id").alias(id_col), *more, F.lit(share).alias("score"), F.lit(int(share >= threshold)).alias("predicted"))

    sure = 3.0
    lexicon = learn_lexicon(sample.where("fold < 3").drop("fold"))
    ready = saved(_featured(sample.where("fold >= 3").select("label", "fold", "text"), lexicon, sure), "toxicity-features").withColumn("features", array_to_vector("features"))
    trees_on, rest = ready.where("fold < 5"), ready.where("fold = 5")
    if min(trees_on.where("label = 1").count(), trees_on.where("label = 0").count(), rest.count()) == 0:
        trees_on = rest = ready
    weighted = trees_on.withColumn("w", F.lit(1.0))
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="w", maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=64, minInstancesPerNode=5, subsamplingRate=1.0, seed=seed).fit(weighted)
    raw = lambda df: model.transform(df).withColumn("p", vector_to_array("probability")[1])
    calibrated = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(raw(rest).select("p", "label"))
    scored = calibrated.transform(raw(_featured(texts, lexicon, sure).withColumn("features", array_to_vector("features"))).select("__id", *more, "p"))
    score = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    return scored.select(F.col("__id").alias(id_col), *more, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
