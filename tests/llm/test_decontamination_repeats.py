"""Decontamination where words repeat in items and texts: the same hits, and work that stays linear."""

import random
import time

import pytest

from arraymill.llm.decontamination import WindowIndex, covered


def brute(items, words, window):
    hit, ids = set(), set()
    for name, item in items:
        size = min(window, len(item))
        known = {tuple(item[s : s + size]) for s in range(len(item) - size + 1)} if size else set()
        for s in range(len(words) - size + 1):
            if size and tuple(words[s : s + size]) in known:
                hit |= set(range(s, s + size))
                ids.add(name)
    return len(hit), ids - {None}


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_few_different_words(window):
    rnd = random.Random(window)
    for _ in range(150):
        letters = [b"a", b"b", b"c"][: rnd.randint(1, 3)]
        make = lambda n, letters=letters: [rnd.choice(letters) for _ in range(n)]
        items = [(str(k) if k else None, make(rnd.randint(0, 40))) for k in range(4)]
        words = make(rnd.randint(0, 80))
        runs, ids = WindowIndex(items, {b"a": rnd.randint(0, 3), b"b": 1}, window).hits(words)
        assert (covered(runs), ids) == brute(items, words, window)


def test_equal_words_are_linear():
    index = WindowIndex([("i", [b"la"] * 1_000), ("j", [b"la", b"lo"] * 500)], {}, 13)
    begin = time.process_time()
    runs, ids = index.hits([b"la"] * 100_000)
    assert (covered(runs), ids) == (100_000, {"i"})
    assert index.hits([b"la", b"lo"] * 50_000)[1] == {"j"}
    assert time.process_time() - begin < 3
    assert sum(map(len, index.prefix.values())) <= 4
