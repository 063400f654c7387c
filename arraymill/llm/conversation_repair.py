"""Conversation structure repair: min-plus transfer matrices over a Re-Pair grammar of role and fault sequences.

A row of a conversation is a symbol: the class of its role (s, u, a or other) and its fault. A repaired conversation spells
`(s?(ua)+)?` with the initials of its roles; the automaton has four states: nothing yet, after s, after u, after a. What
the cheapest edits of some rows cost from state i to state j is a 4 x 4 matrix, and the matrix of rows in a row is the
min-plus product of theirs. So the order of evaluation is free: Re-Pair replaces the pairs of symbols that are most
frequent over all conversations by new symbols, the matrix of each rule is computed once, bottom-up, and every
conversation uses it.

An entry is (cost, audit): least cost first, then the ASCII-least audit. This order survives products: from a state an
audit fixes the states it runs through, so of two audits of equal cost between the same states none begins the other.
An audit is a rope: a string or a pair of ropes, the halves of a rule share theirs with all that use it.

Long conversations are split: rows are range-partitioned by conversation and turn, pieces get a matrix each, and only
the pieces' matrices and counts meet by conversation. Texts are moved once, for the digest of what is repaired, which
reads a conversation's rows in order as a stream; a digest has no parts, so this is one task for each conversation.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import BATCH_ROWS, _batches_of, sliced
from .common import partitions, saved

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Rows of a piece at most; rounds of Re-Pair and rules added in each: the grammar, which every task gets, stays small.
PIECE, ROUNDS, RULES = 1024, 4, 32
#: Symbols are characters from here on: 3 * role class + fault, then the rules in their order.
FIRST, BASE = 0x100, 12
_ROLES = {"s": 0, "u": 1, "a": 2}
CLEAN, DROP, OPEN = 0, 1, 2
_FAULTS = {None: CLEAN, "blank": DROP, "duplicate": DROP, "truncated": OPEN}
_STATES = range(4)
_BLANKS = " \t\n\x0b\f\r"
#: What follows a state when a user or an assistant is put there.
_NEXT = {0: 2, 1: 2, 3: 2, 2: 3}

def flat(rope) -> str:
    """The string of a rope."""
    out, rest = [], [rope]
    while rest:
        r = rest.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            rest += [r[1], r[0]]
    return "".join(out)


def _better(a, b):
    """The lesser of two entries; None is worse than all."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if flat(a[1]) <= flat(b[1]) else b


def product(a, b):
    """Min-plus product of two matrices; an audit is the pair of its parts."""
    out = [[None] * 4 for _ in _STATES]
    for i in _STATES:
        for k in _STATES:
            for j in _STATES:
                if a[i][k] and b[k][j]:
                    out[i][j] = _better(out[i][j], (a[i][k][0] + b[k][j][0], (a[i][k][1], b[k][j][1])))
    return out


def _inserts():
    """Any number of inserts between two rows."""
    out = [[(0, "") if i == j else None for j in _STATES] for i in _STATES]
    for i in _STATES:
        j, n = i, 0
        while n < 2:
            j, n = _NEXT[j], n + 1
            out[i][j] = _better(out[i][j], (INSERT * n, "I" * n))
    return out


INSERTS = _inserts()


def symbol_matrix(code: int):
    """Inserts, then one row of this role class and fault: kept, given another role, or deleted."""
    role, fault = divmod(code, 3)
    row = [[(DELETE, "D") if i == j else None for j in _STATES] for i in _STATES]
    if fault != DROP:
        extra = TRUNCATED * (fault == OPEN)
        for i, j in _NEXT.items():
            row[i][j] = (REROLE + extra, "R")
        keeps = ([(0, 1)], [(0, 2), (1, 2), (3, 2)], [(2, 3)], [])[role]
        for i, j in keeps:
            row[i][j] = (extra, "K")
    return product(INSERTS, row)


def _symbol(head: str, fault: str | None) -> str:
    return chr(FIRST + 3 * _ROLES.get(head, 3) + _FAULTS[fault])


def matrices(rules: list[str]) -> list:
    """Matrices of all symbols, flat: the base symbols, then each rule from those of its two symbols."""
    ropes = [symbol_matrix(c) for c in range(BASE)]
    for pair in rules:
        ropes.append(product(*(ropes[ord(x) - FIRST] for x in pair)))
    return [[[e and (e[0], flat(e[1])) for e in row] for row in m] for m in ropes]


def compressed(sequences: list[str], rules: list[str]) -> list[str]:
    """Sequences with every rule applied in order, its pairs replaced from left to right."""
    text = "\0".join(sequences)
    for k, pair in enumerate(rules):
        text = text.replace(pair, chr(FIRST + BASE + k))
    return text.split("\0")


def grammar(sequences: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> list[str]:
    """Re-Pair over sequences (seq, n): in each round the most frequent pairs of symbols become new symbols.

    The driver gets at most `rules` pairs a round; a task counts in a table of at most (number of symbols) ** 2 entries.
    """
    made: list[str] = []
    for _ in range(rounds):

        def pairs(batches, made=tuple(made)):
            for batch in batches:
                found: Counter = Counter()
                for s, n in zip(compressed(batch.column("seq").to_pylist(), list(made)), batch.column("n").to_pylist(), strict=True):
                    for k in range(len(s) - 1):
                        found[s[k : k + 2]] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

        counted = sequences.mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        new = [r.pair for r in counted.orderBy(F.desc("n"), "pair").limit(rules).collect()]
        if not new:
            break
        made += new
    return made


def _run(vector: list, symbols: str, of: list) -> list:
    """A row vector of entries through the matrices of symbols."""
    for x in symbols:
        m, new = of[ord(x) - FIRST], [None] * 4
        for i, entry in enumerate(vector):
            if entry:
                cost, audit = entry
                for j, step in enumerate(m[i]):
                    if step and (new[j] is None or cost + step[0] < new[j][0] or (cost + step[0] == new[j][0] and audit + step[1] < new[j][1])):
                        new[j] = (cost + step[0], audit + step[1])
        vector = new
    return vector


_TRANSFER = "i int, j int, cost long, audit string"


def transfers(seq: str, whole: bool, of: list) -> list[dict]:
    """The entries of a compressed sequence: from the first state where it is a whole conversation, else from all."""
    out = []
    for i in range(1 if whole else 4):
        vector = _run([(0, "") if k == i else None for k in _STATES], seq, of)
        out += [{"i": i, "j": j, "cost": e[0], "audit": e[1]} for j, e in enumerate(vector) if e]
    return out


class Chain:
    """Entries over the pieces of one conversation, from its first: an audit is a list of strings, linked backwards."""

    def __init__(self):
        self.vector = {0: (0, None)}

    @staticmethod
    def _less(a, b) -> bool:
        """Whether an audit comes before another of as many pieces; what they share is not compared."""
        left, right = [], []
        while a is not b:
            left.append(a[1])
            right.append(b[1])
            a, b = a[0], b[0]
        return "".join(reversed(left)) < "".join(reversed(right))

    def add(self, entries: list[dict]) -> None:
        new: dict = {}
        for e in entries:
            if e["i"] in self.vector:
                before, audit = self.vector[e["i"]]
                mine = (before + e["cost"], (audit, e["audit"]))
                have = new.get(e["j"])
                if have is None or mine[0] < have[0] or (mine[0] == have[0] and self._less(mine[1], have[1])):
                    new[e["j"]] = mine
        self.vector = new

    def end(self) -> tuple[int, str]:
        ends = []
        for j, (cost, audit) in self.vector.items():
            parts = []
            while audit is not None:
                parts.append(audit[1])
                audit = audit[0]
            for k in (0, 3):
                if INSERTS[j][k]:
                    ends.append((cost + INSERTS[j][k][0], "".join(reversed(parts)) + INSERTS[j][k][1]))
        return min(ends)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after damage by crc32(`conv_id:turn`) % 20; null values count as one space.

    0 drops the row, 1 empties its text, 2 removes its `.`, `!` and `?`, 3 makes two copies of it, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(code == 4, "user").otherwise(part("role"))
    return conversations.where(code != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(code == 3, 2).otherwise(1).alias("copies"))


_PIECE = "part long, whole boolean, seq string, head string, last string, illegal long, blank long, duplicate long, truncated long, turns long, first_turn {0}, last_turn {0}, least {0}, most {0}"
_COUNTS = ("illegal", "blank", "duplicate", "truncated")
_LEGAL = {"su", "ua", "au"}


def _pieces(light: DataFrame) -> DataFrame:
    """Sequences of at most PIECE rows of a conversation, in order of part, with counts that add up over pieces.

    light: conv, turn, digest, head (initial of the role), blank, truncated, copies, fresh (no such row before). A piece is
    whole if no other piece of its conversation can exist.
    """
    turn, conv = light.schema["turn"].dataType.simpleString(), light.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", conv), *T._parse_datatype_string(_PIECE.format(turn))])
    order = ["conv", "turn", "digest"]
    placed = light.repartitionByRange(partitions(light.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        done, piece, symbols, none = 0, None, [], object()
        conv_now, alone = none, False  # alone: the conversation began in this part, and this is its first piece

        def closed(whole):
            return {**piece, "part": base + done, "whole": whole, "seq": "".join(symbols)}

        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                new = conv_now is none or r["conv"] != conv_now
                for copy in range(r["copies"]):
                    if new or len(symbols) == PIECE:
                        if piece is not None:
                            rows.append(closed(new and alone))
                            done += 1
                        alone = new and conv_now is not none
                        conv_now, new, symbols = r["conv"], False, []
                        piece = {"conv": conv_now, "head": r["head"], "last": None, **dict.fromkeys(_COUNTS, 0), "turns": 0, "first_turn": r["turn"], "last_turn": None, "least": None, "most": None}
                    fault = "blank" if r["blank"] else "duplicate" if copy or not r["fresh"] else "truncated" if r["truncated"] else None
                    if fault:
                        piece[fault] += 1
                    symbols.append(_symbol(r["head"], fault))
                    if piece["last"] is not None:
                        piece["illegal"] += piece["last"] + r["head"] not in _LEGAL
                    if r["turn"] is not None:
                        piece["turns"] += r["turn"] != piece["most"]
                        piece["most"] = r["turn"]
                        if piece["least"] is None:
                            piece["least"] = r["turn"]
                    piece["last"], piece["last_turn"] = r["head"], r["turn"]
            if len(rows) >= 256:
                yield from pa.Table.from_pylist(rows, arrow).to_batches()
                rows = []
        if piece is not None:
            rows.append(closed(False))
        yield from pa.Table.from_pylist(rows, arrow).to_batches()

    arrow = to_arrow_schema(schema)
    return saved(placed.mapInArrow(run, schema), "repair_pieces")


def _judged(pieces: DataFrame, rules: list[str]) -> DataFrame:
    """One row a conversation: its counts, cost and audit."""
    kind = T.StructType([*pieces.drop("seq").schema, T.StructField("transfers", T.ArrayType(T._parse_datatype_string(_TRANSFER)))])
    of, arrow = matrices(rules), to_arrow_schema(kind)

    def evaluate(batches):
        for batch in sliced(batches, 64):
            seqs, whole = compressed(batch.column("seq").to_pylist(), rules), batch.column("whole").to_pylist()
            known: dict = {}
            for s, w in zip(seqs, whole, strict=True):
                if (s, w) not in known:
                    known[s, w] = transfers(s, w, of)
            cells = [batch.column(c) for c in arrow.names[:-1]]
            yield pa.RecordBatch.from_arrays([*cells, pa.array([known[x] for x in zip(seqs, whole, strict=True)], arrow.field("transfers").type)], schema=arrow)

    conv = pieces.schema["conv"].dataType
    out = T.StructType([T.StructField("conv", conv), *T._parse_datatype_string("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")])
    to = to_arrow_schema(out)

    def combine(batches):
        rows = []
        for conv_id, parts in groupby((r for b in batches for k in range(0, b.num_rows, 256) for r in b.slice(k, 256).to_pylist()), key=itemgetter("conv")):
            chain, total, last = Chain(), Counter(), None
            least = most = None
            for p in parts:
                chain.add(p["transfers"])
                for c in _COUNTS:
                    total[c] += p[c]
                total["turns"] += p["turns"]
                if last is not None:
                    total["illegal"] += last["last"] + p["head"] not in _LEGAL
                    total["turns"] -= p["first_turn"] is not None and p["first_turn"] == last["last_turn"]
                least = p["least"] if least is None else least
                most = p["most"] if p["most"] is not None else most
                last = {"last": p["last"], "last_turn": p["last_turn"]}
            cost, audit = chain.end()
            gaps = 0 if least is None else int(most - least) + 1 - total["turns"]
            rows.append({"conv": conv_id, "gaps": gaps, **{c: total[c] for c in _COUNTS}, "cost": cost, "audit": audit})
            if len(rows) >= 1024:
                yield from pa.Table.from_pylist(rows, to).to_batches()
                rows = []
        yield from pa.Table.from_pylist(rows, to).to_batches()

    placed = pieces.mapInArrow(evaluate, kind).repartition(partitions(pieces.sparkSession), "conv").sortWithinPartitions("conv", "part")
    return placed.mapInArrow(combine, out)


def _repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """judged with repaired_sha256, from the rows in their order, read as a stream behind their audit."""
    heads = judged.select("conv", F.lit(0).alias("kind"), F.struct(*judged.columns[1:]).alias("judged"))
    texts = rows.select("conv", F.lit(1).alias("kind"), "turn", "digest", "role", "text", "copies")
    both = heads.unionByName(texts, allowMissingColumns=True)
    placed = both.repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "kind", "turn", "digest")
    out = T.StructType([*judged.schema, T.StructField("repaired_sha256", T.StringType())])
    to = to_arrow_schema(out)

    def run(batches):
        rows = []
        for conv_id, parts in groupby((r for b in batches for k in range(0, b.num_rows, 256) for r in b.slice(k, 256).to_pylist()), key=itemgetter("conv")):
            head = next(parts)["judged"]
            sha, audit, at, last = hashlib.sha256(), head["audit"], 0, None

            def put(role, text, sha=sha):
                nonlocal last
                sha.update(f"{'' if last is None else chr(10)}{role}:{text}".encode())
                last = role

            def following():
                return "assistant" if last is not None and last[:1] == "u" else "user"

            for r in parts:
                for _ in range(r["copies"]):
                    while audit[at] == "I":
                        put(following(), "")
                        at += 1
                    if audit[at] != "D":
                        put(r["role"] if audit[at] == "K" else following(), r["text"])
                    at += 1
            for _ in audit[at:]:
                put(following(), "")
            rows.append({"conv": conv_id, **head, "repaired_sha256": sha.hexdigest()})
            if len(rows) >= 1024:
                yield from pa.Table.from_pylist(rows, to).to_batches()
                rows = []
        yield from pa.Table.from_pylist(rows, to).to_batches()

    with _batches_of(rows.sparkSession, BATCH_ROWS):
        return saved(placed.mapInArrow(run, out), "repair_done")


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def repair(rows: DataFrame, conversations: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> DataFrame:
    """Faults and cheapest repair of every conversation.

    rows: conv_id, turn, role, text, copies (so many equal rows, next to each other); conversations: conv_id of all that
    are reported. A row's fault is the first of: blank (no character but ASCII white space), duplicate (its role and text
    stood in an earlier row), truncated (its last such character is none of `.!?`). Rows go by turn, nulls first; rows of
    one turn go by the SHA-256 of role and text.

    Returns conv_id, gaps (turns missing between the first and the last), blank, duplicate, truncated, illegal (neighbours
    whose initials are not su, ua or au), cost, audit and repaired_sha256. Null roles and texts count as one space; an empty
    role has no initial and is never kept; null ids are one conversation; repeated rows are duplicates; a conversation
    without rows has zeros, an empty audit and the digest of nothing; no conversations give an empty table; other columns
    are ignored.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    base = rows.select(F.col("conv_id").alias("conv"), "turn", value("role").alias("role"), value("text").alias("text"), F.col("copies").cast("long").alias("copies"))
    keyed = base.withColumn("digest", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    end = _trimmed(F.col("text"))
    flags = [F.substring("role", 1, 1).alias("head"), (F.length(end) == 0).alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated")]
    light = keyed.select("conv", "turn", "digest", *flags, "copies").groupBy("conv", "turn", "digest", "head", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    # where a row stood first: least turn of its role and text in the conversation
    member = F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), F.lit(" "), "digest"), 256)
    light = light.withColumn("member", member).withColumn("when", F.struct(F.col("turn").isNotNull().alias("some"), "turn"))
    first = light.groupBy("member").agg(F.min("when").alias("first"))
    fresh = light.join(first, "member").select("conv", "turn", "digest", "head", "blank", "truncated", "copies", (F.col("when") == F.col("first")).alias("fresh"))
    pieces = _pieces(fresh)
    made = grammar(saved(pieces.groupBy("seq").agg(F.count("*").alias("n")), "repair_sequences"), rounds, rules)
    done = _repaired(keyed, _judged(pieces, made))
    every = conversations.select(F.col("conv_id").alias("conv_id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = every.join(done, every["conv_id"].eqNullSafe(done["conv"]), "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
