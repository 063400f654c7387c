"""Substring dedup against a brute-force version."""

import hashlib
import random
import re

import numpy as np
import pytest

from arraymill.llm import substring_dedup as S

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, size):
    """(id, n_words, n_removed, sha256 of what stays) of each row; a null id comes after all others."""
    key = lambda i: (i is None, i or 0)
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - size + 1):
            g = tuple(w[s : s + size])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < key(i):
                gone[s : s + size] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def taken(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_given_documents_and_odd_rows(docs, rows, none):
    got = taken(S.substring_dedup(docs, keep_text=False))
    assert got == brute(rows, 50)
    assert sum(r[2] for r in got) > 0
    assert S.substring_dedup(none).count() == 0


@pytest.mark.parametrize("size,gram,block_bytes", [(10, 4, 2_000), (10, 8, 1 << 20), (7, 1, 500), (50, 16, 4_000)])
def test_random_passages(spark, size, gram, block_bytes):
    """Passages of many lengths, moved, nested and repeated, over few different words, ties of ids and repeated rows."""
    rnd = random.Random(size)
    passages = [[f"w{rnd.randrange(30)}" for _ in range(rnd.randint(size - 2, size * 4))] for _ in range(12)]
    made = []
    for i in range(150):
        words = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 3)
            words += rnd.choice([p, p[a:], p[: len(p) - a], ["x"] * rnd.randint(0, 2 * size), [f"q{rnd.randrange(10**6)}" for _ in range(size)]])
        made.append((rnd.randrange(120) if i % 40 else None, rnd.choice([" ", "\n", " \t "]).join(words) or rnd.choice([None, "", "  "])))
    made += made[:5]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert taken(S.substring_dedup(df, size=size, gram=gram, block_bytes=block_bytes, keep_text=False)) == brute(made, size)


def test_kept_texts_and_factors(spark):
    """Each factor is a copy of the named place, factors cover what is removed, and kept words are the rest."""
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(300)]
    made = [(i, " ".join([*[f"u{i}_{j}" for j in range(rnd.randint(0, 20))], *base[(a := rnd.randint(0, 150)) : a + rnd.randint(40, 150)]])) for i in range(40)]
    texts = {i: t.split() for i, t in made}
    for r in S.substring_dedup(spark.createDataFrame(made, "doc_id long, text string"), size=20, gram=8).collect():
        gone = set()
        for f in r.factors:
            assert f.ref_id < r.doc_id and f.length >= 20
            assert texts[r.doc_id][f.start : f.start + f.length] == texts[f.ref_id][f.ref_start : f.ref_start + f.length]
            gone |= set(range(f.start, f.start + f.length))
        assert len(gone) == r.n_removed
        assert r.kept.split() == [w for k, w in enumerate(texts[r.doc_id]) if k not in gone]


def test_a_passage_in_all_documents_and_long_words(spark):
    """A passage of one window more than a context, in every document, with different neighbours; a word beyond a chunk."""
    passage = " ".join(f"p{i}" for i in range(51))
    made = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(400)] + [(1000, "z" * (S.CHUNK + 10) + " " + passage), (1001, "")]
    got = taken(S.substring_dedup(spark.createDataFrame(made, "doc_id long, text string")))
    assert [r[2] for r in got] == [0, *[51] * 400, 0]
    assert got == brute(made, 50)
