"""Sets that meet at frequent shingles are ordered again among themselves; no pair is lost by it."""

import functools
import random

from arraymill.llm import near_duplicates as N

from .test_near_exact import edited, want

COLUMNS = "token long, key long, root long, n long, pos long"


def test_frequent_shingles_make_no_pairs_of_all(spark):
    first = [(5, k, k, 10, 0) for k in range(40)] + [(6, k, k, 10, 0) for k in (100, 101)]
    again = [(50 + k, k, k, 10, 0) for k in range(38)] + [(9, k, k, 10, 0) for k in (38, 39)]
    asked = []

    def prefixes(keys):
        asked.append(keys and sorted(r.key for r in keys.collect()))
        return spark.createDataFrame(again if keys else first, COLUMNS)

    got = [(q.a, q.b) for q in N._proposed(prefixes, 800, many=8).collect()]
    assert sorted(got) == [(38, 39), (100, 101)] and asked == [None, list(range(40))]


def test_a_pair_meets_once_not_once_a_shingle(spark):
    rows = [(t, k, k, 30, t) for t in range(6) for k in (1, 2, 3)] + [(t, k, k, 30, 9) for t in (7, 8) for k in (1, 2)]
    shared = N._shared(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r.key, r.m, r.pos) for r in shared) == [(1, 2, 9), (1, 3, 0), (2, 2, 9), (2, 3, 0), (3, 3, 0)]


def test_all_pairs_by_rounds(spark, monkeypatch):
    r, texts = random.Random(3), []
    line = [f"common{i}" for i in range(14)]
    for _ in range(40):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(3, 40))] + line
        texts += [" ".join(base), " ".join(edited(base, r, r.randrange(1, 4)))]
    lines = [" ".join(f"l{i}-{j}" for j in range(6)) for i in range(6)]
    texts += [" ".join([*r.sample(lines, 4), *[f"x{i}-{j}" for j in range(i % 5)]]) for i in range(60)]
    rounds = []
    made = N._prefixes
    monkeypatch.setattr(N, "_prefixes", lambda *a: rounds.append(a[-1]) or made(*a))
    monkeypatch.setattr(N, "_proposed", functools.partial(N._proposed, many=2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {q.row.doc_id: q.component_id for q in N.near_duplicates(df, shingle=3, block_bytes=1 << 10).collect()}
    assert [got[i] for i in range(len(texts))] == want(texts, 0.8, 3) and len(rounds) > 1
