"""Merkle dataset manifest: a content-addressed DAG of digests, and proofs by descent from its root.

Rows are leaves; the leaves of a group, by id, fold in runs of two to the group's subroot, and subroots, by group, fold alike
to the root. Nodes are stored by content: a record names a node's children, and the records of BITS levels below a node
are one row of the store, under the digest of that node. A proof descends: leaf requests follow the digits of BITS bits of
their rank from the root; requests that share a prefix descend it once; at each node the children not selected are
collected; and the collected segments, reversed, are the proof from leaf to root.

Every join is on a digest or on a group and a run of ranks, so it holds at most 2 ** BITS rows of a request: a group
with most of the rows is no hot key anywhere.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import sliced
from .common import partitions, saved

#: Levels in one row of the store, and bits of a digit of a rank.
BITS = 6
_RUN = 1 << BITS
#: The name of the tree over the subroots; trees of groups are named "=" + group, and "" where the group is null.
_TOP = "/"
_NODES = "tree string, n long, rank long, digest string, records array<struct<node: string, children: array<string>>>"
_STEP = "tree string, index long, digest string, path array<binary>, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A field of a leaf: `-` if null, else its number of UTF-8 bytes, `:`, and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rank 0, 1, ... inside their tree and n, the tree's number of rows, without a window over a tree.

    Rows are range-partitioned by tree and order and written, since the ranges come from a sample; ranks inside a part
    are shifted by the counts of the tree's parts before it.
    """
    placed = saved(rows.repartitionByRange(partitions(rows.sparkSession), "tree", *order).withColumn("part", F.spark_partition_id()), "merkle_leaves")
    parts = Window.partitionBy("tree").orderBy("part")
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("c")).select("tree", "part", (F.sum("c").over(parts) - F.col("c")).alias("base"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    inner = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    return placed.withColumn("rank", inner).join(counts, ["tree", "part"]).withColumn("rank", (F.col("rank") - 1 + F.col("base")).cast("long")).drop("part", "base")


def _fold(level: list[str], height: int) -> tuple[str, list[dict]]:
    """(top, records) of nodes folded `height` times in runs of two; a last run of one becomes its digest too."""
    records = []
    for _ in range(height):
        runs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [digest("".join(r)) for r in runs]
        records += [{"node": d, "children": r} for d, r in zip(level, runs, strict=True)]
    return level[0], records


def _height(n: int) -> int:
    return (n - 1).bit_length()


def _store(nodes: DataFrame) -> list[DataFrame]:
    """The store by steps of BITS levels, leaves first: tree, n, rank of the run, digest of its top, records.

    nodes: tree, n, rank, digest. How many steps there are follows the largest tree.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    steps: list[DataFrame] = []
    while not steps or _height(largest) > BITS * len(steps):
        below = BITS * len(steps)

        def fold(batches, below=below):
            for batch in sliced(batches, 1024):
                rows = []
                for r in batch.to_pylist():
                    top, records = _fold([x["digest"] for x in r["run"]], min(BITS, max(0, _height(r["n"]) - below)))
                    rows.append({"tree": r["tree"], "n": r["n"], "rank": r["rank"], "digest": top, "records": records})
                yield from pa.Table.from_pylist(rows, _arrow()).to_batches()

        runs = nodes.groupBy("tree", "n", F.shiftright("rank", BITS).alias("rank")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("run"))
        steps.append(saved(runs.mapInArrow(fold, _NODES), "merkle_store"))
        # a tree that has come down to one run of this step is folded whole
        nodes = steps[-1].where(F.col("n") > (1 << (below + BITS))).select("tree", "n", "rank", "digest")
    return steps


def _arrow() -> pa.Schema:
    records = pa.list_(pa.struct([("node", pa.string()), ("children", pa.list_(pa.string()))]))
    return pa.schema([("tree", pa.string()), ("n", pa.int64()), ("rank", pa.int64()), ("digest", pa.string()), ("records", records)])


def _tops(steps: list[DataFrame]) -> DataFrame:
    """(tree, digest, at): the top node of each tree and the step that it is the only run of."""
    found = [s.where((F.col("rank") == 0) & (F.col("n") <= (1 << (BITS * (i + 1)))) & (F.col("n") > (1 << (BITS * i) if i else 0))).select("tree", "digest", F.lit(i).alias("at")) for i, s in enumerate(steps)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@dataclass
class Manifest:
    """leaves: the columns given, with tree, rank and leaf. groups, top: the stores of the trees of groups and of the tree
    over them. subroots: tree, digest, at (its step), rank, n. root: one row, digest, or none of an empty table."""

    leaves: DataFrame
    groups: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: DataFrame

    def records(self) -> DataFrame:
        """digest, children: every inner node once."""
        out = None
        for s in [*self.groups, *self.top]:
            r = s.select(F.explode("records").alias("r")).select(F.col("r.node").alias("digest"), "r.children")
            out = r if out is None else out.unionByName(r)
        return out.dropDuplicates(["digest"])


def manifest(leaves: DataFrame, group: str, id_col: str) -> Manifest:
    """The manifest of rows with their digest in `leaf`; null groups come first, ids ascend, null ids first, and rows that
    tie by id go by digest (repeated rows are leaves each)."""
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    named = leaves.withColumn("tree", tree).withColumn("__id", F.col(id_col)).withColumn("__tie", F.monotonically_increasing_id())
    ranked = saved(_ranked(named, ["__id", "leaf", "__tie"]).drop("__id", "__tie"), "merkle_ranked")
    groups = _store(ranked.select("tree", "n", "rank", F.col("leaf").alias("digest")))
    tops = _tops(groups).select(F.lit(_TOP).alias("tree"), F.col("tree").alias("name"), "digest", "at")
    subroots = saved(_ranked(tops, ["name"]), "merkle_subroots")
    top = _store(subroots.select("tree", "n", "rank", "digest"))
    return Manifest(ranked.drop("n"), groups, top, subroots.select(F.col("name").alias("tree"), "digest", "at", "rank"), _tops(top).select("digest", "at"))


def _descend(requests: DataFrame, begin: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """requests (tree, rank, carry) with what descent finds: digest, path (root first), subroot, root.

    begin: digest, path, subroot, root, at of each tree. A path entry is one byte, the place of the selected child in its
    run, and the digests of the others. One row a (tree, rank) of requests.
    """
    asked = None
    for i in reversed(range(len(steps))):
        starts = begin.where(F.col("at") == i).select("tree", F.lit(0).cast("long").alias("index"), "digest", "path", "subroot", "root")
        asked = starts if asked is None else asked.unionByName(starts)
        last = i == 0
        digit = F.shiftright("rank", BITS * i).bitwiseAND(_RUN - 1).cast("int").alias("digit")
        wanted = requests.select("tree", F.shiftright("rank", BITS * (i + 1)).alias("index"), digit, *(["carry"] if last else []))
        wanted = (wanted if last else wanted.distinct()).groupBy("tree", "index").agg(F.collect_list(F.struct(*wanted.columns[2:])).alias("wanted"))
        # records are content: equal runs of one step are stored once
        store = steps[i].select("digest", "n", "records").dropDuplicates(["digest"])

        def walk(batches, i=i, last=last):
            for batch in sliced(batches, 128):
                rows, from_ = [], []
                carry = batch.column("wanted").values if last else None
                base = batch.column("wanted").offsets.to_pylist() if last else None
                for k, r in enumerate(batch.select(["tree", "index", "digest", "path", "subroot", "root", "n", "records"]).to_pylist()):
                    children = {x["node"]: x["children"] for x in r["records"]}
                    depth = min(BITS, max(0, _height(r["n"]) - BITS * i))
                    digits = batch.column("wanted")[k].values.field("digit").to_pylist()
                    for j, d in enumerate(digits):
                        node, path = r["digest"], list(r["path"])
                        for bit in range(depth - 1, -1, -1):
                            run, at = children[node], d >> bit & 1
                            path.append(bytes([at]) + bytes.fromhex("".join(run[:at] + run[at + 1 :])))
                            node = run[at]
                        rows.append({"tree": r["tree"], "index": r["index"] * _RUN + d, "digest": node, "path": path, "subroot": r["subroot"], "root": r["root"]})
                        if last:
                            from_.append(base[k] + j)
                out = pa.Table.from_pylist(rows, _STEPS)
                if last:
                    out = out.append_column("carry", carry.field("carry").take(pa.array(from_, pa.int64())))
                yield from out.to_batches()

        joined = asked.join(wanted, ["tree", "index"]).join(store, "digest")
        kind = requests.schema["carry"].dataType.simpleString()
        asked = joined.mapInArrow(walk, _STEP + f", carry {kind}" * last)
    return asked.withColumnRenamed("index", "rank")


_STEPS = pa.schema([("tree", pa.string()), ("index", pa.int64()), ("digest", pa.string()), ("path", pa.list_(pa.binary())), ("subroot", pa.string()), ("root", pa.string())])


def proofs(made: Manifest, requests: DataFrame) -> DataFrame:
    """For each requested leaf (tree, rank, carry, a struct that is passed on; each leaf once): digest, path, subroot, root.

    The path goes from the leaf to the root; an entry is the place of the node in its run (one byte) and the digests of the
    others in the run, 32 bytes each.
    """
    nowhere = F.array().cast("array<binary>")
    roots = made.root.select(F.lit(_TOP).alias("tree"), "digest", nowhere.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), "at")
    found = _descend(made.subroots.select(F.lit(_TOP).alias("tree"), "rank", F.struct(F.col("tree").alias("name"), F.col("at").alias("start")).alias("carry")), roots, made.top)
    begin = saved(found.select(F.col("carry.name").alias("tree"), "digest", "path", F.col("digest").alias("subroot"), "root", F.col("carry.start").alias("at")), "merkle_paths")
    out = _descend(requests, begin, made.groups)
    return out.select("tree", "rank", "carry", "digest", F.reverse("path").alias("path"), "subroot", "root")


def folded(leaf: str, path: list[bytes]) -> str:
    """The root that a leaf and its siblings give."""
    for entry in path:
        run = [entry[k : k + 32].hex() for k in range(1, len(entry), 32)]
        run.insert(entry[0], leaf)
        leaf = digest("".join(run))
    return leaf


def dataset_manifest(docs: DataFrame, id_col: str = "doc_id", group: str = "lang", count: str = "n_chars", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tamper=None) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and what a tampered row's leaf folds to with the original siblings.

    tamper: a boolean Column, the rows in which `count` is one more than recorded; none by default. Returns id_col, leaf,
    subroot, root, proof_sha256 (of the proof's digests, leaf to root, left to right), folded_root and verified.

    Any field may be null, texts may be empty or long; null ids come first in their group and rows of equal ids go by
    leaf; repeated rows are leaves each; an empty table gives an empty one; other columns are ignored.
    """
    more = {count: (F.col(count).cast("decimal(20,0)") + 1)}
    leaf = leaf_digest(*[F.col(f) for f in fields])
    changed = leaf_digest(*[more.get(f, F.col(f)) for f in fields])
    rows = docs.select(F.col(id_col).alias("id"), F.col(group).alias("group"), leaf.alias("leaf"), (F.when(tamper, changed).otherwise(leaf) if tamper is not None else leaf).alias("tampered"))
    made = manifest(rows, "group", "id")
    found = proofs(made, made.leaves.select("tree", "rank", F.struct("id", "tampered").alias("carry")))

    def verify(batches):
        for batch in batches:
            paths, tampered = batch.column("path").to_pylist(), batch.column("tampered").to_pylist()
            joined = ["".join(e[1:].hex() for e in p) for p in paths]
            ends = [folded(t, p) for t, p in zip(tampered, paths, strict=True)]
            verified = [a == b for a, b in zip(ends, batch.column("root").to_pylist(), strict=True)]
            cells = [*[batch.column(c) for c in ("id", "leaf", "subroot", "root")], pa.array(map(digest, joined), pa.string()), pa.array(ends, pa.string()), pa.array(verified, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cells, names=[id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = docs.schema[id_col].dataType.simpleString()
    flat = found.select(F.col("carry.id").alias("id"), F.col("carry.tampered").alias("tampered"), F.col("digest").alias("leaf"), "subroot", "root", "path")
    return flat.mapInArrow(verify, f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
