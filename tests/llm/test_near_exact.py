"""No pair of texts that meets the threshold is left out: groups are the components of all such pairs, by brute force."""

import random

import pytest

from arraymill.llm.near_duplicates import _met, near_duplicates
from arraymill.llm.simhash import shingle_hashes


def edited(words, r, times):
    words = list(words)
    for _ in range(times):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return words


def want(texts, similarity, shingle):
    sets = [set(shingle_hashes(t.encode(), shingle, 42).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both * 1000 >= round(similarity * 1000) * (len(a) + len(b) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_all_pairs(spark, similarity):
    r = random.Random(7)
    line = [f"common{i}" for i in range(12)]
    texts = ["", " ", "one", "one", "two words", "a b c d e f"]
    for _ in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(6, 80))] + (line if r.random() < 0.5 else [])
        texts += [" ".join(base), " ".join(edited(base, r, r.randrange(1, 4)))]
    texts += [" ".join([*line, f"x{i}"]) for i in range(20)] + [texts[8]] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {q.row.doc_id: q.component_id for q in near_duplicates(df, similarity=similarity, shingle=3, block_bytes=1 << 10).collect()}
    assert [got[i] for i in range(len(texts))] == want(texts, similarity, 3)


def test_tiles_meet_once(spark):
    rows = [(5, k, k, 10, 0) for k in range(40)] + [(6, k, 0, 10, 0) for k in range(40)]
    rows += [(7, k, 100 + k % 2 * (k > 50), 10, 0) for k in range(100, 120)]
    df = spark.createDataFrame(rows, "token long, key long, root long, n long, pos long")
    got = [(q.a, q.b) for q in _met(df, 800, tile=7).collect()]
    across = [(a, b) for a in range(100, 120) for b in range(a + 1, 120) if a % 2 != b % 2]
    assert sorted(got) == sorted([(a, b) for a in range(40) for b in range(a + 1, 40)] + across)
