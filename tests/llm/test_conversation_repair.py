"""Conversation repair against a brute-force version: shortest paths over edits, written without matrices or grammar."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from arraymill.llm import conversation_repair as C

BLANK = re.compile(r"[^\x20\x09-\x0D]")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def damage(rows):
    """conv -> rows (turn, role, text) in their order, after damage."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        mine += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, sha(f"{len(r[1].encode())}:{r[1]}{r[2]}"))) for c, rs in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        chars = BLANK.findall(text)
        out.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired rows) by uniform-cost search over (rows read, initials so far as a state)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    best, done = [(0, "", 0, "", ())], set()
    while best:
        cost, audit, at, state, made = heapq.heappop(best)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, made
        if (at, state) in done:
            continue
        done.add((at, state))
        step = lambda c, letter, n, s, more: heapq.heappush(best, (cost + c, audit + letter, at + n, s, (*made, *more)))
        for x in "ua":
            if x in after[state]:
                step(3, "I", 0, x, [f"{names[x]}:"])
        if at < len(rows):
            _, role, text = rows[at]
            step(4, "D", 1, state, [])
            if found[at] not in ("blank", "duplicate"):
                extra = 3 * (found[at] == "truncated")
                if role[:1] in after[state]:
                    step(extra, "K", 1, role[:1], [f"{role}:{text}"])
                for x in "ua":
                    if x in after[state]:
                        step(3 + extra, "R", 1, x, [f"{names[x]}:{text}"])
    raise AssertionError


def brute(rows):
    out = []
    for conv, mine in damage(rows).items():
        found = faults(mine)
        cost, audit, made = cheapest(mine, found)
        turns = [t for t, *_ in mine if t is not None]
        heads = [r[:1] for _, r, _ in mine]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(heads)), cost, audit, sha("\n".join(made))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def taken(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=lambda r: (r[0] is None, r[0] or 0))


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, conv string, digest string").repartition(3)
    return taken(C.repair(C.damaged(df), df, **options))


def random_rows(seed, conversations=120):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", "Ok!", "é?", "", " \n", " ", "Why ", "a.b ", None, "x" * 5000 + "."]
    rows = []
    for c in range(conversations):
        for t in range(rnd.choice([1, 2, 3, 5, 9, 14])):
            turn = t if rnd.random() < 0.85 else rnd.choice([None, t, t + 3, 0])
            rows.append((c if c else None, turn, rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "U"]), rnd.choice(texts)))
    return rows + rows[:15]


def test_random_conversations(spark):
    rows = random_rows(1)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rounds,rules", [(0, 8), (1, 2), (9, 64)])
def test_any_grammar_gives_the_same(spark, rounds, rules):
    rows = random_rows(2, 40)
    assert run(spark, rows, rounds=rounds, rules=rules) == brute(rows)


def test_long_conversations_are_split(spark, monkeypatch):
    """A conversation of many pieces over all partitions, beside short ones; pieces of seven rows."""
    monkeypatch.setattr(C, "PIECE", 7)
    rnd = random.Random(4)
    rows = [(7, t, rnd.choice(["user", "assistant", "assistant", "system"]), f"{rnd.randrange(60)}{rnd.choice(['.', '', '!'])}") for t in range(400)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"t{t}.") for c in (3, 8) for t in range(6)]
    assert run(spark, rows) == brute(rows)


def test_ropes_and_products():
    """A product of matrices is the matrix of the longer sequence, whatever the grouping; ties go to the least audit."""
    rnd = random.Random(5)
    for _ in range(30):
        codes = [rnd.randrange(C.BASE) for _ in range(6)]
        ms = [C.symbol_matrix(c) for c in codes]
        left, right = ms[0], ms[-1]
        for m in ms[1:]:
            left = C.product(left, m)
        for m in reversed(ms[:-1]):
            right = C.product(m, right)
        plain = lambda m: [[e and (e[0], C.flat(e[1])) for e in row] for row in m]
        assert plain(left) == plain(right)


def test_empty_tables_and_conversations_without_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert C.repair(C.damaged(spark.createDataFrame([], kind)), spark.createDataFrame([], kind)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
