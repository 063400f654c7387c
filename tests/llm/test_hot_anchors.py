"""Passages that so many texts hold that their anchors are hot; shards that are sorted once; long texts in chunks."""

import hashlib
import random

import numpy as np
import pytest

from arraymill.llm import suffix_dedup
from arraymill.llm.blocks import buckets_for, key_ranges

from .test_operators import brute_repeats, taken

NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
NO_HOT = np.zeros(0, np.uint64)


def shards_of(blocks, size, gram, section=1 << 16):
    out = []
    for texts in blocks:
        raw = b"".join(texts)
        found = suffix_dedup.Anchors.of(np.frombuffer(raw, np.uint8), np.array([len(t) for t in texts]), size, gram)
        out += [suffix_dedup.Shard(raw, found, np.arange(a, min(a + section, len(found.at))), size, gram, NO_HOT) for a in range(0, len(found.at), section)]
    return out


def held(shard):
    flat = np.frombuffer(b"".join(shard.contexts(np.arange(len(shard.hash)))), np.uint8)
    return {**{c: getattr(shard, c) for c in ("hash", "weight", "left", "right", "common", "turn", "turn_common")}, "contexts": flat}


def test_hot_anchors(spark):
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("xyzw é") for _ in range(n))
    short, long = noise(30), noise(120)
    rows = [(i, noise(r.randint(0, 60)) + r.choice([short, long, long[:70], long[20:]]) + noise(r.randint(0, 60))) for i in range(300)]
    rows += [(1000 + i, r.choice(rows[:40])[1]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows, 40)
    for hot in (0, 30, 100_000):
        assert taken(suffix_dedup.remove_repeats(df, size=40, gram=8, block_bytes=5_000, hot=hot, section=100, merge_bytes=2_000), *NAMES) == want, hot


def test_different_contexts_are_counted_and_hot_ones_leave_the_merge():
    r = random.Random(9)
    noise = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    passage, same = noise(150), noise(400)
    texts = [noise(150) + passage + noise(150) for _ in range(200)] + [same] * 200
    raw, lengths = b"".join(texts), np.array([len(t) for t in texts])
    anchors = suffix_dedup.Anchors.of(np.frombuffer(raw, np.uint8), lengths, 200, 32)
    keys, counts, various = anchors.counted()
    brute = {}
    for h, a, low, high in zip(*(x.tolist() for x in (anchors.hash, anchors.at, anchors.low, anchors.high)), strict=True):
        brute.setdefault(h, []).append((a - low, raw[low : high + 200]))
    assert {k: (n, v) for k, n, v in zip(keys.tolist(), counts.tolist(), various.tolist(), strict=True)} == {h: (len(c), len(set(c))) for h, c in brute.items()}
    hot = keys[various > 50]
    assert len(hot) and (counts[various == 1] >= 200).any()
    shard = suffix_dedup.Shard(raw, anchors, np.arange(len(anchors.at)), 200, 32, hot)
    assert set(shard.hash[shard.hot].tolist()) == set(hot.tolist())
    parts = list(shard.strings(most=64))
    assert len(parts) > 1
    seen = {(int(i), int(d)): bytes(x) for of, far, digests in parts for i, d, x in zip(of, far, digests, strict=True)}
    want = {}
    for i, context in zip(np.flatnonzero(shard.hot).tolist(), shard.contexts(np.flatnonzero(shard.hot)), strict=True):
        for b in range(len(context) - 199):
            want[i, int(shard.left[i]) - b] = hashlib.blake2b(context[b : b + 200], digest_size=16).digest()
    assert seen == want


def test_anchor_keys_fill_equal_ranges_evenly():
    data = np.frombuffer(np.random.default_rng(1).bytes(400_000), np.uint8)
    found = suffix_dedup.Anchors.of(data, np.array([len(data)]), 200, 32)
    shares = [b - a for _, a, b in key_ranges(np.sort(found.hash), suffix_dedup.KEY_BITS, 16)]
    assert len(shares) == 16
    assert max(shares) < 1.5 * len(found.at) / 16


@pytest.mark.parametrize("chunk", [300, 4_096, 1 << 19])
def test_chunks_name_the_same_strings_and_anchors_survive_packing(chunk):
    data = np.frombuffer(bytes(random.Random(2).choice(b"abc") for _ in range(20_000)), np.uint8)
    lengths = np.array([0, 150, 9_850, 0, 10_000])
    whole, cut = (suffix_dedup.Anchors.of(data, lengths, 200, 32, chunk=c) for c in (1 << 19, chunk))
    cut = suffix_dedup.Anchors.unpacked(cut.packed())
    named = lambda f: {s: (int(h), int(p)) for h, p, a, b in zip(f.hash, f.at, f.low, f.high, strict=True) for s in range(a, b + 1)}
    assert named(whole) == named(cut)
    assert len(named(whole)) == 9_850 - 199 + 10_000 - 199


def test_a_merge_never_sorts_a_shard_again_and_finds_the_common_prefixes():
    r = random.Random(6)
    noise = lambda n: bytes(r.choice(b"ab\0") for _ in range(n))
    base = noise(300)
    blocks = [[base[(x := r.randint(0, 200)) : x + r.randint(40, 90)] + noise(30) for _ in range(40)] for _ in range(3)]
    shards = shards_of(blocks, 40, 8, section=120)
    assert len(shards) > 3
    for s in shards:  # sorted once, with true depths of neighbours
        strings = [(int(h), s.raw[p:e], s.raw[b:p][::-1]) for h, b, p, e in zip(s.hash, s.begin, s.anchor, s.end, strict=True)]
        assert strings == sorted(set(strings))
        turned = [(strings[i][0], strings[i][2]) for i in s.turn.tolist()]
        assert turned == sorted(turned)
    count = [len(s.hash) for s in shards]
    number = np.repeat(np.arange(len(shards)), count)
    keys = np.concatenate([s.hash for s in shards])
    symbols = np.concatenate([suffix_dedup.rows_of_symbols(np.frombuffer(s.raw, np.uint8), s.anchor, s.right, 40) for s in shards])
    row, common = suffix_dedup.interleaved(keys, number, symbols, np.concatenate([s.common for s in shards]))
    for k in range(len(shards)):
        own = row[number[row] == k]
        assert (np.diff(own) == 1).all()  # the shard's rows in the order that it brought
    padded = [(int(keys[i]), symbols[i].tobytes()) for i in row.tolist()]
    assert padded == sorted(padded)
    for k in range(1, len(row)):
        same = next((d for d in range(40) if padded[k][1][d] != padded[k - 1][1][d]), 40) if padded[k][0] == padded[k - 1][0] else 0
        assert common[k] == same


def test_one_text_over_eight_mebibytes(spark):
    r = np.random.default_rng(7)
    text = "".join(map(chr, (97 + r.integers(0, 26, 9 << 20)).tolist()))
    passage, twice = text[1_000_000:1_000_250], text[4_194_200:4_194_420]
    long = text[:7_000_000] + twice + text[7_000_000:]
    rows = [(1, long), (2, "AB" * 50 + passage + "CD" * 50), (3, None), (4, "short")]
    right = next(k for k in range(99) if text[7_000_000 + k] != text[4_194_420 + k])  # copies may run on by chance
    left = next(k for k in range(99) if text[6_999_999 - k] != text[4_194_199 - k])
    got = {x.doc_id: tuple(x)[1:4] for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_bytes=False).select(*NAMES).collect()}
    assert got == {1: (len(long), 250 + 2 * (220 + left + right), 3), 2: (450, 250, 1), 3: (0, 0, 0), 4: (5, 0, 0)}


def test_merges_follow_the_bytes():
    assert [buckets_for(n, 8 << 20) for n in (0, 1, 8 << 20, 80 << 20, 160 << 20)] == [1, 1, 1, 10, 20]
