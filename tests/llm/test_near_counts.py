"""Shingles are ordered by how many sets have them, whatever the number of shingles: few sets meet."""

import random
from collections import Counter

import numpy as np

from arraymill.llm import near_duplicates as N
from arraymill.llm.simhash import shingle_hashes

from .test_near_exact import edited, want


def texts_with_a_line(r, many=50):
    line = [f"common{i}" for i in range(6)]
    return [" ".join([f"w{r.randrange(10**9)}" for _ in range(r.randrange(30, 50))] + line) for _ in range(many)]


def test_sets_with_enough_shingles_of_their_own_make_no_rows(spark, monkeypatch):
    r, made, saved = random.Random(1), [], N.saved
    texts = texts_with_a_line(r)
    base = texts[0].split()
    texts += [" ".join(edited(base[:30], r, 1) + base[30:])]  # one pair shares a prefix shingle
    monkeypatch.setattr(N, "saved", lambda df, name, **k: made.append((name, saved(df, name, **k))) or made[-1][1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {q.row.doc_id: q.component_id for q in N.near_duplicates(df, shingle=3, block_bytes=1 << 10).collect()}
    assert [got[i] for i in range(len(texts))] == want(texts, 0.8, 3)
    prefixes = [f for name, f in made if name == "near_prefixes"]
    assert len(prefixes) == 1 and prefixes[0].select("key").distinct().count() == 2


def test_counts_are_whole_in_any_number_of_ranges(spark, monkeypatch):
    texts = texts_with_a_line(random.Random(2)) + ["", "one", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    blocks = N._blocks(df, "text", 1 << 10)
    none = spark.createDataFrame([], "block long, key long, root long, copy boolean")
    monkeypatch.setattr(N, "RANGE", 200)
    total = sum(len(np.unique(shingle_hashes(t.encode(), 3, 42))) for t in texts)
    rows = N._counts(blocks, none, "text", 3, 42, True, total).collect()
    assert len({q.range for q in rows}) > 5 and len({q.block for q in rows}) == 3
    found = Counter()
    for block in blocks.collect():
        hashes = [np.unique(shingle_hashes(t, 3, 42)) for t in N._texts(N._rows(block.rows), "text")]
        classes, _ = N._classes([(0, 0, h) for h in hashes], N._class_bits(total))
        sets = np.concatenate([N.unpack(q.sets) for q in sorted((q for q in rows if q.block == block.block), key=lambda q: q.range)] or [np.zeros(0, np.uint32)])
        assert len(sets) == len(classes)
        found |= Counter(dict(zip(classes.tolist(), sets.tolist(), strict=True)))
    shift = np.uint64(64 - N._class_bits(total))
    assert found == Counter(int(h >> shift) for t in texts for h in np.unique(shingle_hashes(t.encode(), 3, 42)))
