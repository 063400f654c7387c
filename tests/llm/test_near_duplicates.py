"""Near duplicates against exact overlaps of all pairs."""

import random
from collections import defaultdict

import pytest

from arraymill.llm.near_duplicates import near_duplicates
from arraymill.llm.queries import table

from .test_pipeline import LARGER, alike, shingles


def groups(rows):
    """id -> least id of its component, by the overlap of all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s or {None}:
            by[g].append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if alike(sets[a], sets[b])]
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, links


@pytest.fixture(scope="module")
def copies():
    """Texts with edited copies, chains of edits and one large group."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows, bases = [], [[word() for _ in range(rnd.randint(30, 400))] for _ in range(40)]
    for k, base in enumerate(bases):
        for _ in range(60 if k == 0 else rnd.randint(1, 5)):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 60))):
                words[rnd.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words).upper() if rnd.random() < 0.1 else "  ".join(words)))
    return rows


def test_groups_of_edited_copies(spark, copies):
    want, links = groups(copies)
    rows = near_duplicates(spark.createDataFrame(copies, "doc_id long, text string").repartition(3), block_bytes=20_000).collect()
    got = {r.row.doc_id: r.component_id for r in rows}
    assert len(rows) == len(copies) and {r.row.doc_id for r in rows if r.kept} == set(got.values())
    found = sum(got[a] == got[b] for a, b in links)
    assert found >= 0.98 * len(links) and len(links) > 500
    assert all(want[i] == want[c] for i, c in got.items())  # nothing else is joined


def test_recall_on_given_documents(spark):
    docs = table(spark, LARGER, "documents")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want, links = groups(rows)
    got = {r.row.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    distinct = [(a, b) for a, b in links if dict(rows)[a] != dict(rows)[b]]
    assert sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    assert sum(got[a] == got[b] for a, b in distinct) >= 0.9 * len(distinct)
    assert all(want[i] == want[c] for i, c in got.items())


def test_odd_rows_keep_their_columns(spark, docs, none):
    rows = near_duplicates(docs).collect()
    assert sorted(map(str, (tuple(r.row) for r in rows))) == sorted(str(tuple(r)) for r in docs.collect())
    empty = [r for r in rows if not (r.row.text or "").strip()]
    assert len({r.component_id for r in empty}) == 1 and sum(r.kept for r in empty) == 1
    assert near_duplicates(none).count() == 0
