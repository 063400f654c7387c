"""The Merkle manifest against a brute-force version."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arraymill.llm import merkle
from arraymill.llm.queries import held_out

KIND = "doc_id long, source string, lang string, n_chars long, text string, leaf string, rank int, tree string"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, extra=0):
    fields = (r[0], r[1], r[2], None if r[3] is None else r[3] + extra, r[4])
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(nodes):
    """Levels from the nodes to the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def steps(levels, at):
    """(place in the run, the run's others) of a node, level by level."""
    for nodes in levels[:-1]:
        run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        yield at % 2, run[: at % 2] + run[at % 2 + 1 :]
        at //= 2


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([leaf(r) for r in sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g, rs in groups.items()}
    top = tree([made[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            path = [*steps(made[g], at), *steps(top, k)]
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for place, others in path:
                node = H(*[*others[:place], node, *others[place:]])
            root = top[-1][0]
            out.append((r[0], leaf(r), made[g][-1][0], root, H(*[x for _, o in path for x in o]), node, node == root))
    return out


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(7)
    value = lambda make: None if rnd.random() < 0.1 else make()
    langs = ["en"] * 40 + ["de", "é", "", "zz"]
    rows = [(i if i % 30 else None, value(lambda: "src"), value(lambda: rnd.choice(langs)), value(lambda: rnd.randint(-3, 10**6)), value(lambda: "tëxt " * rnd.randint(0, 30))) for i in range(700)]
    rows += [(5000 + i % 3, "s", "ties", 1, f"t{i}") for i in range(9)]  # ids that tie
    rows += [rows[-1]] * 5 + [(6000, "s", "lone", 1, "x" * 300_000)]  # repeated rows, a group of one, a long text
    return rows


def taken(df):
    return Counter(tuple(r) for r in df.collect())


def test_manifest(spark, table):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in table], KIND).repartition(5)
    got = taken(merkle.dataset_manifest(df, tamper=held_out(7)))
    assert got == Counter(brute(table))
    assert 0 < sum(n for r, n in got.items() if not r[-1]) < len(table)


@pytest.mark.parametrize("n", [1, 2, 3, 63, 64, 65, 129])
def test_sizes_around_a_row_of_the_store(spark, n):
    rows = [(i, "s", "a", 1, "t") for i in range(n)]
    assert taken(merkle.dataset_manifest(spark.createDataFrame([(*r, "", 1, "") for r in rows], KIND), tamper=held_out(7))) == Counter(brute(rows))


def test_many_groups(spark):
    rows = [(i, "s", f"g{i % 150:03d}", 1, "t") for i in range(400)]
    assert taken(merkle.dataset_manifest(spark.createDataFrame([(*r, "", 1, "") for r in rows], KIND), tamper=held_out(7))) == Counter(brute(rows))


def test_empty(spark):
    assert merkle.dataset_manifest(spark.createDataFrame([], KIND)).count() == 0


def test_store_and_proofs_of_some_leaves(spark, table):
    df = spark.createDataFrame(table, "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.manifest(df.withColumn("leaf", merkle.leaf_digest(*[F.col(c) for c in df.columns])), "lang", "doc_id")
    records = made.records().collect()
    assert all(r.digest == H(*r.children) for r in records)
    assert len({r.digest for r in records}) == len(records)
    root = made.root.first().digest
    known = {r.digest for r in records} | {r.leaf for r in made.leaves.select("leaf").collect()}
    assert root in known and all(c in known for r in records for c in r.children)
    asked = made.leaves.where("rank % 50 = 3").select("tree", "rank", F.struct("leaf").alias("carry"))
    found = merkle.proofs(made, asked).collect()
    assert len(found) == asked.count() > 5
    for r in found:
        assert r.digest == r.carry.leaf
        assert merkle.folded(r.digest, r.path) == r.root == root
        assert merkle.folded(H("other"), r.path) != root
