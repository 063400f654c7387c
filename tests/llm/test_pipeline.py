"""Each stage of the corpus pipeline against a brute-force version on its own input."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from arraymill.llm.queries import ORACLE_SQL, QUERIES, held_out, table, tokenizer_path
from arraymill.llm.tokens import tokenizer

from ..conftest import SF
from .test_operators import LOWER


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the output of every stage, each written and read again."""
    docs = table(spark, SF, "documents")
    out = {}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def kept(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    size = min(5, len(words))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if size else set()


def alike(a, b):
    shared = len(a & b)
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def test_order_and_columns(stages, spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "bpe"]
    columns = table(spark, SF, "documents").columns
    for name, (_, out) in list(stages.items())[:-1]:
        assert out.columns == columns, name
    assert stages["bpe"][1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_toxicity_removes_toxic_and_keeps_clean_documents(spark):
    docs = table(spark, LARGER, "documents")
    before, after = kept(docs), kept(P.toxicity(spark, docs, LARGER))
    labels = {r.doc_id: r.toxic for r in table(spark, LARGER, "labels").where("toxic is not null").collect()}
    held = [r.doc_id for r in docs.where(held_out(5)).select("doc_id").collect()]
    for ids in (list(before), held):
        toxic, clean = ({i for i in ids if labels.get(i) == k} for k in (1, 0))
        assert len(clean & after.keys()) >= 0.9 * len(clean)
        assert len(toxic - after.keys()) >= 0.5 * len(toxic) > 0
    assert all(before[i] == t for i, t in after.items())


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_decide_by_row_where_ids_are_null_or_repeated(spark, docs):
    """docs has null ids, repeated rows, null, empty and long texts and clashing columns; some ids get a second text."""
    twice = docs.where("doc_id < 20").withColumn("text", F.concat(F.lit("once more "), F.coalesce("text", F.lit(""))))
    docs = docs.unionByName(twice).unionByName(docs.where("doc_id is null or doc_id in (3, 20005)"))
    rows = counted(docs)
    i, t = docs.columns.index("doc_id"), docs.columns.index("text")
    text = lambda r: r[t] or ""
    out = {name: stage(spark, docs, SF) for name, stage in P.STAGES}
    assert all(df.columns == docs.columns for name, df in out.items() if name != "bpe")
    got = {name: counted(df) for name, df in out.items()}

    least = lambda x: (x is None, x)
    texts = {}
    for r in rows:
        texts.setdefault(text(r), []).append(r[i])
    exact = got["exact_dedup"]
    assert exact.total() == len(texts) and not exact - rows
    for r in exact:
        assert r[i] == max((x for x in texts[text(r)] if x is not None), default=None)

    sets = {x: shingles(x) for x in texts}
    names = list(texts)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(names):
        for y in names[:k]:
            if alike(sets[x], sets[y]):
                root[find(x)] = find(y)
    near, first = got["simhash_near_dedup"], {}
    for x in names:
        first[find(x)] = min([*texts[x], *([first[find(x)]] if find(x) in first else [])], key=least)
    assert near.total() == len(first) and not near - rows
    assert {find(text(r)): r[i] for r in near} == first

    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(LOWER))
    hit = contaminated(texts, [words(r.text or "") for r in table(spark, SF, "benchmark").collect()], words)
    assert got["decontamination"] == Counter({r: n for r, n in rows.items() if text(r) not in hit})

    toxic = got["toxicity"]
    assert not toxic - rows
    assert all(n == rows[r] for r, n in toxic.items())
    assert not {text(r) for r in toxic} & {text(r) for r in rows if r not in toxic}

    library, sha = tokenizer(tokenizer_path("byte_bpe_50k.json")), lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for r, n in rows.items():
        ids = library.encode(text(r), add_special_tokens=False).ids
        want[r[i], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += n
    assert got["bpe"] == want


def contaminated(texts, items, words):
    windows = {}
    for w in items:
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(w[k : k + n]))
    out = set()
    for x in texts:
        w, hit = words(x), set()
        for n, known in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            out.add(x)
    return out


def test_exact_dedup(stages):
    before, after = (kept(x) for x in stages["exact_dedup"])
    last = {}
    for i, t in before.items():
        last[t] = max(i, last.get(t, i))
    assert set(after) == set(last.values())


def test_near_dedup(stages):
    before, after = (kept(x) for x in stages["simhash_near_dedup"])
    ids = sorted(before)
    sets = {i: shingles(before[i]) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and alike(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {i for i in ids if find(i) == i}


def test_decontamination(stages, spark):
    before, after = (kept(x) for x in stages["decontamination"])
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    hit = contaminated(before.values(), [words(r.text) for r in table(spark, SF, "benchmark").collect()], words)
    assert set(after) == {i for i, t in before.items() if t not in hit}


def test_run_and_registration(stages, spark):
    import __spark_entry__ as e

    assert sorted(r.doc_id for r in P.run(spark, SF).select("doc_id").collect()) == sorted(kept(stages["bpe"][0]))
    names = e.queries()
    assert names["pipeline"].__wrapped__ is P.run
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_take_empty_documents(spark):
    none = table(spark, SF, "documents").where(F.lit(False))
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0
