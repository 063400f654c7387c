"""Each operator against a brute-force version, odd rows included, and on an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arraymill.llm import bpe, decontamination, exact_dedup, lm, simhash, suffix_dedup, token_counts, token_files, toxicity, warc
from arraymill.llm.queries import held_out, tokenizer_path
from arraymill.llm.tokens import tokenizer

from ..conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
order = lambda r: (r[0] is None, r[0] or 0, [str(x) for x in r[1:]])


def taken(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=order)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, rows, none, keep):
    out = exact_dedup.exact_dedup(docs, keep=keep)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    pick = lambda ids: (max if keep == "largest" else min)((i for i in ids if i is not None), default=None)
    want = sorted(((i, pick(groups[t]), len(groups[t]), sha(t)) for i, t in rows), key=order)
    assert taken(out, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert out.where("kept").count() == len(groups)
    assert out.where("kept and not doc_id <=> keep_id").count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_of_a_hot_text_and_repeated_rows(spark):
    many = [(i % 500, "same") for i in range(1000)] + [(1000 + i, f"t{i}") for i in range(500)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(many, "doc_id long, text string"), keep="largest")
    hot = out.where("group_size > 1")
    assert (hot.count(), hot.where("keep_id = 499").count(), hot.where("kept").count(), out.where("kept").count()) == (1000, 1000, 1, 501)


def test_token_counts(docs, rows, none):
    path = tokenizer_path("byte_bpe_50k.json")
    t = tokenizer(path)
    want = sorted(((i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for i, x in rows), key=order)
    assert taken(token_counts.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(none, path).count() == 0


def test_bpe(docs, rows, none):
    path = tokenizer_path("byte_bpe_50k.json")
    t = tokenizer(path)
    want = []
    for i, x in rows:
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    got = taken(bpe.encode_decode(docs, path, block_chars=200_000), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=order)
    back = bpe.decode(bpe.encode(docs, path), path)
    assert taken(back, "doc_id", "decoded") == sorted(rows, key=order)
    assert bpe.encode_decode(none, path).count() == 0


def test_token_files(docs, rows, none, spark, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    t = tokenizer(path)
    known = docs.where("doc_id is not null")
    got = [tuple(r) for r in token_files.token_output(known, path, 2).orderBy("doc_id").collect()]
    start, want = 0, []
    for i, x in sorted(r for r in rows if r[0] is not None):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.token_output(docs, path, 2).count() == len(rows)
    assert token_files.token_output(none, path, 2).count() == 0
    token_files.write_tokens(known, str(tmp_path / "t"), path, 2)
    some = token_files.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 20004").first()
    assert some.tokens == [*t.encode("one two").ids, 2]


def test_token_files_of_tied_and_null_ids_are_reproducible(spark):
    path = tokenizer_path("word_bpe_49k.json")
    t = tokenizer(path)
    texts = [(i % 3 if i % 4 else None, f"text {i % 7} of one id") for i in range(40)]
    runs = []
    for parts in (1, 5):
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
        runs.append(sorted(map(tuple, token_files.token_output(df, path, 2).collect()), key=lambda r: r[1]))
    assert runs[0] == runs[1]
    ids = [r[0] for r in runs[0]]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in runs[0]] == [sum(r[2] for r in runs[0][:k]) for k in range(len(runs[0]))]
    crc = lambda x: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert Counter((r[0], r[3]) for r in runs[0]) == Counter((i, crc(x)) for i, x in texts)


def test_layout_of_token_files(spark, tmp_path):
    """The files as written: list columns with dictionary pages, row groups near their size, an index of short pages."""
    import glob

    import pyarrow.parquet as pq

    words = [f"word{i}" for i in range(3_000)]
    r = np.random.default_rng(3)
    rows = [(i, " ".join(words[k] for k in r.integers(0, 3_000, 400))) for i in range(4_000)]
    path = str(tmp_path / "t")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, tokenizer_path("word_bpe_49k.json"), 2)
    files = sorted(glob.glob(f"{path}/*.parquet"))
    seen = []
    for name in files:
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 40 << 20
            columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
            tokens = next(c for k, c in columns.items() if k.startswith("tokens"))
            assert "RLE_DICTIONARY" in tokens.encodings
            assert tokens.has_dictionary_page
            assert all(c.compression == "ZSTD" and c.has_offset_index and c.has_column_index for c in columns.values())
        seen += pq.read_table(name, columns=["doc_id"]).column(0).to_pylist()
    assert len(files) == 4
    assert seen == list(range(4_000))
    plan = token_files.read_tokens(spark, path).select("doc_id", "start")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("Physical Plan")[1]  # metadata is read without the ids


def test_lm(docs, rows, none):
    docs, rows = docs.where("doc_id is not null"), [r for r in rows if r[0] is not None]
    got = {r.doc_id: r for r in lm.lm_scores(docs, train=~held_out(10), order=3, block_bytes=100_000).collect()}
    text = {i: [*re.findall(r"[^\x20\x09-\x0D]+", x.translate(LOWER)), "\0end"] for i, x in rows}
    train = {i for i in text if zlib.crc32(str(i).encode()) % 10}
    c1 = Counter(w for i in train for w in text[i])
    c2, c3 = Counter(), Counter()
    for i in train:
        s = ["\0begin", *text[i]]
        c2.update(zip(s, s[1:]))
        c3.update(zip(s, s[1:], s[2:]))
    total, distinct = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w] + 0.1) / (total + 0.1 * (distinct + 1))
    seen = lambda v: len(train) if v == "\0begin" else c1[v]
    bins = lambda n: int(math.log2(max(n, 1)))
    cells = Counter()
    for i in train:
        s = ["\0begin", *text[i]]
        for k in range(1, len(s)):
            low = p1(s[k])
            for n, c, ctx in ((2, c2[s[k - 1], s[k]], seen(s[k - 1])), *([(3, c3[s[k - 2], s[k - 1], s[k]], c2[s[k - 2], s[k - 1]])] if k > 1 else [])):
                r = int(min(max(math.floor(math.log2((c - 1) / max(ctx - 1, 1) / low)) - lm.RATIO_LOW, 1), lm.RATIOS - 1)) if c > 1 else 0
                cells[n, bins(ctx), r] += 1
                low = 0.5 * c / max(ctx, 1) + 0.5 * low
    share = lm.weights([(*k, v) for k, v in cells.items()], 3)

    def p(n, context, w):
        if not n:
            return p1(w)
        lower = p(n - 1, context[1:], w)
        ctx = seen(context[0]) if n == 1 else c2[context]
        count = c2[(*context, w)] if n == 1 else c3[(*context, w)]
        return share[n + 1, bins(ctx)] * count / ctx + (1 - share[n + 1, bins(ctx)]) * lower if ctx else lower

    for i, words in text.items():
        g, s = got[i], ["\0begin", *words]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(words), sum(c1[w] > 0 for w in words), total)
        assert g.base_score == pytest.approx(sum(math.log10(p1(w)) for w in words), rel=1e-9)
        want = sum(math.log10(p(min(k, 2), tuple(s[max(0, k - 2) : k]), s[k])) for k in range(1, len(s)))
        assert g.score == pytest.approx(want, rel=1e-9)
    held = [i for i in text if i not in train]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    assert lm.lm_scores(none, train=~held_out(10)).count() == 0
    untrained = lm.lm_scores(docs.limit(5), train=F.lit(False)).collect()
    assert all(r.n_known == 0 and r.score == pytest.approx(r.base_score) for r in untrained)


def token_log_probabilities(automaton, text):
    """log10 probability of each token of a text of the automaton's block, one arc after the other."""
    b, s, out = automaton.block, automaton.start, []
    for place in range(int(b.first[text]) + 1, int(b.first[text] + b.sizes[text])):
        log, arc = 0.0, int(b.text[place])
        while automaton.level[s]:
            n = int(automaton.level[s])
            number = automaton.base[n] + int(b.at[n - 1][place])
            if not math.isnan(automaton.weight[number]):
                arc = number
                break
            log, s = log + automaton.fail_weight[s], automaton.fail[s]
        out.append(log + automaton.weight[arc])
        s = automaton.next[arc]
    return out


def test_lm_distribution_sums_to_one(spark):
    """After each context, the probabilities of all words, of the end, and of one word that was never seen sum to one."""
    texts = ["a b a b c", "a b", "c c a", "b", ""]
    contexts = ["", "a", "a b", "b a", "unseen", "a unseen", "c c"]
    following = ["a", "b", "c", "never"]
    probes = [" ".join(filter(None, [x, w])) for x in contexts for w in ["", *following]]
    df = spark.createDataFrame(list(enumerate(texts + probes)), "doc_id long, text string").coalesce(1)
    blocks = lm._blocks(df, F.col("doc_id") < len(texts), "doc_id", "text", lm.BLOCK_BYTES, 3)
    block = lm.Block(blocks.toArrow(), 3)
    assert block.ids.to_pylist() == list(range(len(texts + probes)))
    found = lm._words(blocks).unionByName(lm._grams(blocks, 3, 3))
    distinct, total = found.agg(F.sum("distinct"), F.sum("total")).first()
    counts = lm.Counts(block, found.toArrow(), len(texts), 3)
    model = lm.Model(total + len(texts), distinct + 1, np.random.default_rng(2).uniform(0.1, 0.9, (4, lm.BINS)))
    automaton = lm.Automaton(block, counts, model, 3)
    scores = automaton.scores()
    each = [token_log_probabilities(automaton, k) for k in range(len(texts + probes))]
    assert scores.tolist() == pytest.approx([sum(x) for x in each])
    for i, x in enumerate(contexts):
        at = len(x.split())
        mine = each[len(texts) + 5 * i : len(texts) + 5 * i + 5]
        assert sum(10 ** log[at] for log in mine) == pytest.approx(1.0)  # the end, the words, the word never seen


def test_lm_of_null_and_repeated_rows(spark):
    base = [(1, "a b c"), (2, "a b"), (3, "b c a"), (None, "a b c"), (None, None), (4, ""), (5, None)]
    once = spark.createDataFrame(base, "doc_id long, text string")
    rows = [(None if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 9)) for r in lm.lm_scores(once, train=F.col("doc_id") < 4).collect()]
    assert Counter(r[0] for r in rows) == Counter(i for i, _ in base)  # null ids are scored, and a null `train` is false
    assert {r[3] for r in rows} == {4 + 3 + 4}
    assert {r[1:3] for r in rows if r[0] is None} == {(4, 4), (1, 1)}
    twice = lm.lm_scores(once.unionByName(once.where("doc_id = 1")), train=F.col("doc_id") < 4).collect()
    assert sum(r.doc_id == 1 for r in twice) == 2  # a row each, and each counts
    assert {r.train_tokens for r in twice} == {4 + 3 + 4 + 4}
    assert len({r.score for r in twice if r.doc_id == 1}) == 1


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not words:
        return 0
    n = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, none):
    prints = [brute_simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        f = find(k)
        least[f] = min((x for x in (least.get(f), i) if x is not None), default=None)
    want = sorted(((i, f"{p:016x}", least[find(k)]) for k, ((i, _), p) in enumerate(zip(rows, prints, strict=True))), key=order)
    assert taken(simhash.near_dedup(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_dedup(none).count() == 0


def test_simhash_links_in_large_and_tiled_buckets(spark):
    r = np.random.default_rng(1)
    centres = r.integers(0, 2**63, 40, dtype=np.uint64)
    values = set()
    for _ in range(3000):
        x = int(centres[r.integers(0, 40)])
        for _ in range(int(r.integers(0, 4))):
            x ^= 1 << int(r.integers(0, 64))
        values.add(x)
    values = sorted(values)
    v = np.array(values, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 2
    label = np.arange(len(v))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    prints = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    from arraymill.llm.components import components

    for tile in (8192, 16):
        found = {r.node: r.root for r in components(simhash.links(prints, 2, tile=tile)).collect()}
        groups = defaultdict(set)
        for k, x in enumerate(v.view(np.int64).tolist()):
            groups[found.get(x, x)].add(int(label[k]))
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len(set(label.tolist()))


def test_decontamination(docs, rows, none, spark):
    item = rows[3][1].split()
    items = [(1, " ".join(item[2:30])), (2, "one"), (3, None), (4, "!!"), (None, "one two"), (5, " ".join(item[40:53])), (5, " ".join(item[40:53])), (6, "you idiot")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(0))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        windows |= {(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n}
    want = []
    for i, t in rows:
        w = words(t)
        hit, ids = set(), set()
        for k, g in windows:
            if len(g) <= len(w) and g[0] in w:
                for a in range(len(w) - len(g) + 1):
                    if tuple(w[a : a + len(g)]) == g:
                        hit |= set(range(a, a + len(g)))
                        ids.add(k)
        ids.discard(None)
        want.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit) and 20 * len(hit) >= len(w)))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want.sort(key=order)
    assert taken(decontamination.decontaminate(docs, benchmark), *names) == want
    assert taken(decontamination.decontaminate(docs, benchmark, most_words=12), *names) == want  # in blocks
    assert decontamination.decontaminate(none, benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.where("false")).where("n_hit > 0").count() == 0


def brute_repeats(rows, size):
    seen = Counter(b[k : k + size] for _, t in rows for b in [t.encode()] for k in range(len(b) - size + 1))
    out = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    return sorted(out, key=order)


def test_suffix_dedup(docs, rows, none):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert taken(suffix_dedup.remove_repeats(docs, block_bytes=100_000), *names) == brute_repeats(rows, 200)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_finds_shifted_and_partial_repeats(spark):
    import random

    r = random.Random(4)
    base = ["".join(r.choice("abc é") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(300):
        b = r.choice(base)
        x = r.randint(0, 200)
        s = "".join(r.choice("xyz") for _ in range(r.randint(0, 20))) + b[x : x + r.randint(20, 90)] + "".join(r.choice("xyz") for _ in range(r.randint(0, 20)))
        rows.append((i, s + s if r.random() < 0.2 else s))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert taken(suffix_dedup.remove_repeats(df, size=40, gram=8, block_bytes=5_000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 40)


def test_warc(spark, tmp_path):
    big = "payload é " * 20
    pages = [(3, "http://a/é?q=1 2", big), (1, "http://b", big), (2, None, big), (4, "http://c\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (None, "u", "no id " * 30), (7, "u", "other " * 50)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = taken(warc.archive(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, t in pages:
        b = (t or "").encode()
        revisit = t == big and i != 1
        want.append((i, len(b), sha(b), "revisit" if revisit else "response", 1 if revisit else None))
    assert got == sorted(want, key=order)
    assert warc.archive(df.where("false")).count() == 0
    path = str(tmp_path / "w")
    index = warc.write_warc(warc.decide(df), path)
    some = warc.read_warc(spark, path, index.where("page_id in ('1', '4')"), payloads=True)
    assert {r.page_id: (r.url, bytes(r.payload).decode()) for r in some.collect()} == {"1": ("http://b", big), "4": ("http://c\r\nX: y", "short")}
    assert warc.coalesced([(0, 10), (10, 5), (30, 5), (99, 1)], 20) == [[(0, 10), (10, 5), (30, 5)], [(99, 1)]]


def test_warc_of_repeated_rows_long_payloads_and_clashing_columns(spark):
    long, other = "é<p>long payload</p> " * 300_000, "x" * 150
    pages = [("null", "u", "a page whose id is the word null " * 9), ("a", "u", long), ("b", "u", long), ("a", "u", long), ("c", "u", other), ("c", "u", other), (None, "u", long), (None, None, None), ("", "", "")]
    df = spark.createDataFrame(pages, "page_id string, url string, html string")
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("id", "payload", "digest", "first", "refers_to", "n", "file", "offset", "cell", "record_type")])
    got = Counter(map(tuple, warc.archive(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    first = {long: "a", other: "c"}
    want = Counter()
    for i, _, t in pages:
        b = (t or "").encode()
        revisit = t in first and i != first[t]
        want[i, len(b), sha(b), "revisit" if revisit else "response", first[t] if revisit else None] += 1
    assert got == want  # a null id's copy revisits, all rows of the first stay responses, and "null" is an id


def test_toxicity_features_by_brute_force():
    r = np.random.default_rng(5)
    words = ["you", "Your", "idiot", "IDIOT", "tu", "fine", "sunny", "id1ot", "b@d", "sooo", "WOW", "né", "12", "awfulness", "awful"]
    marks = [" ", " ", " ", "!! ", "? ", ", ", "\n", " ... "]
    lexicon = {"awful*": 3.5, "sunn*": 1.6, "fine": 2.0, "wow": 4.0}
    for _ in range(300):
        n = int(r.integers(0, 25))
        text = "".join(words[int(r.integers(len(words)))] + marks[int(r.integers(len(marks)))] for _ in range(n))
        got = dict(zip(toxicity.FEATURES, toxicity.features_of(text, lexicon, 3.0), strict=True))
        assert got == pytest.approx(brute_features(text, lexicon, 3.0))
    assert toxicity.features_of(None, lexicon, 3.0) == toxicity.features_of("", lexicon, 3.0) == [0.0] * len(toxicity.FEATURES)


def brute_features(text, lexicon, sure):
    """Every feature on its own, position by position."""
    is_letter = lambda c: c.isalnum() and not c.isdigit() and not c.isdecimal() and not c.isnumeric()
    low = text.lower()
    runs, run = [], ""
    for c in low + " ":
        if is_letter(c):
            run += c
        elif run:
            runs.append(run)
            run = ""
    weight = [max([lexicon.get(k, 0.0) for k in (w, w[:4] + "*", w[:5] + "*", w[:6] + "*")]) for w in runs]
    insult = [w in toxicity.INSULTS for w in runs]
    strong, broad = [x >= sure for x in weight], [x > 0 for x in weight]
    you = [i for i, w in enumerate(runs) if w in toxicity.SECOND_PERSON]
    bad = [i for i in range(len(runs)) if insult[i] or strong[i]]
    gaps = [min(abs(i - j) for j in you) for i in bad] if you else []
    n, chars = max(1, len(runs)), max(1, len(text))
    ascii_letters = sum(c.isascii() and c.isalpha() for c in text)
    mixed = re.findall(r"[^\W\d_]+[0-9@$!*|#]{1,2}[^\W\d_]+", low)
    plain = lambda m: "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}.get(c, c) for c in m)
    longs = k = 0
    while k + 2 < len(low):
        if is_letter(low[k]) and low[k] == low[k + 1] == low[k + 2]:
            longs, k = longs + 1, k + 3
        else:
            k += 1
    return {
        "insult_density": sum(insult) / n, "insult_hits": math.log1p(sum(insult)), "learned_density": sum(strong) / n, "learned_hits": math.log1p(sum(strong)),
        "broad_density": sum(broad) / n, "broad_hits": math.log1p(sum(broad)), "top_weight": max(weight, default=0.0), "second_person": len(you) / n,
        "near_second_person": sum(g <= 6 for g in gaps) / max(1, len(bad)), "nearest_second_person": 1 / (1 + min(gaps)) if gaps else 0.0,
        "upper_rate": sum(c.isascii() and c.isupper() for c in text) / max(1, ascii_letters), "caps_words": len(re.findall(r"\b[A-Z]{3,}\b", text)) / n,
        "exclaim_rate": text.count("!") / chars, "question_rate": text.count("?") / chars, "punctuation_rate": sum(33 <= ord(c) < 127 and not c.isalnum() for c in text) / chars,
        "punctuation_runs": len(re.findall(r"[!?*#$%&]{2,}", text)) / n, "mixed_words": len(mixed) / n, "hidden_insults": sum(plain(m) in toxicity.INSULTS or m.replace("*", "") in toxicity.INSULTS for m in mixed) / n,
        "long_letters": longs / n, "digit_rate": sum(c.isascii() and c.isdigit() for c in text) / chars, "log_words": math.log1p(len(runs)), "word_length": sum(map(len, runs)) / n,
    }


def test_toxicity_lexicon_counts_rows_and_not_occurrences(spark):
    rows = [(1.0, "Vile viler vile words"), (1.0, "vile thing"), (1.0, "vile again"), (1.0, None), (0.0, "kind words"), (0.0, "a vile day"), (0.0, ""), (0.0, "kind"), (0.0, "kind kind")] + [(0.0, f"calm {i}") for i in range(40)]
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "label double, text string").repartition(3))
    terms = lambda t: {w for w in re.findall(r"[a-z]+", (t or "").lower()) for w in (w, *[f"{w[:k]}*" for k in (4, 5, 6) if len(w) > k])}
    one, zero = (Counter(x for label, t in rows if label == k for x in terms(t)) for k in (1.0, 0.0))
    n1, n0 = sum(r[0] == 1 for r in rows), sum(r[0] == 0 for r in rows)
    odds = {x: math.log((c + 0.5) / (n1 + 1)) - math.log((zero[x] + 0.5) / (n0 + 1)) for x, c in one.items() if c >= 3}
    assert got == pytest.approx({x: v for x, v in odds.items() if v >= 1.5})
    assert set(got) == {"vile"}


def toxic_rows(n):
    r = np.random.default_rng(9)
    calm, vile = [f"calm{i}" for i in range(60)], ["you", "idiot", "scum", "trash"]
    rows = []
    for i in range(n):
        toxic = bool(r.integers(2))
        words = [calm[int(k)] for k in r.integers(0, 60, 12)]
        if toxic and r.random() < 0.9:
            words[3:3] = [vile[int(k)] for k in r.integers(0, 4, 3)]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_never_learns_from_rows_held_out_and_conflicting_labels_have_a_rule(spark):
    rows = toxic_rows(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    make = lambda labels: spark.createDataFrame(labels, "doc_id long, toxic int")
    run = lambda labels: {r.doc_id: round(r.score, 9) for r in toxicity.score_toxicity(docs, make(labels), train_on=~held_out(5, "__id"), trees=5).collect()}
    true = [(i, y) for i, _, y in rows]
    score = run(true)
    assert score == run([(i, 1 - y if held(i) else y) for i, y in true])  # labels of the fold held out change nothing
    assert score == run([x for x in true if not held(x[0])])
    # an id with several labels has the largest, in whatever order they come; nulls and null ids do not count
    doubled = [(i, 0) for i, y in true if y] + true + [(i, None) for i, _ in true[:50]] + [(None, 1)] * 20
    assert score == run(doubled)
    assert score == run(doubled[::-1])
    auc = [(score[i] > score[j]) + 0.5 * (score[i] == score[j]) for i, y in true if y and held(i) for j, z in true if not z and held(j)]
    assert sum(auc) / len(auc) > 0.9  # a tenth of the toxic rows has no mark, which leaves about 0.95


def test_toxicity_calibration_is_isotonic_and_fits_the_shares(spark):
    """Scores are non-decreasing steps; on the fold that calibrates, each step is the share of label 1 among its rows."""
    rows = toxic_rows(900)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels, train_on=F.lit(True), trees=5).collect()}
    fold = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(6)) == 5).select("doc_id").collect()}
    blocks = defaultdict(list)
    for i, _, y in rows:
        if i in fold:
            blocks[scored[i]].append(y)
    assert len(fold) > 100 and len(blocks) > 1
    assert sum(len(v) * s for s, v in blocks.items()) == pytest.approx(sum(map(sum, blocks.values())))
    for s, v in blocks.items():
        assert s == pytest.approx(sum(v) / len(v), abs=1e-9)


def test_toxicity(spark, docs, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    scored = toxicity.score_toxicity(real, labels, train_on=~held_out(5, "__id"), trees=10)
    test = scored.join(labels.where("toxic is not null"), "doc_id").where(held_out(5)).select("score", "toxic").collect()
    good = [a.score > b.score for a in test if a.toxic for b in test if not b.toxic]
    assert sum(good) / len(good) > 0.7
    odd = toxicity.score_toxicity(docs, labels, train_on=~held_out(5, "__id"), trees=3)
    assert odd.count() == docs.count()
    assert odd.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    assert toxicity.score_toxicity(none, labels, train_on=F.lit(True), trees=3).count() == 0
    nothing = toxicity.score_toxicity(docs, labels.where("false"), train_on=F.lit(True))
    assert nothing.where("score <> 0").count() == 0
    text = toxicity.features_of("You are an IDIOT!! id1ot sooo", {}, 3.0)
    named = dict(zip(toxicity.FEATURES, text, strict=True))
    assert named["near_second_person"] > 0
    assert named["hidden_insults"] > 0
    assert named["caps_words"] > 0
    assert named["long_letters"] > 0
