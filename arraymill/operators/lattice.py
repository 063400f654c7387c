"""Gaussian filtering on a permutohedral lattice, and the dense CRF that uses it (RS10).

A point of d features lies in a simplex of d + 1 lattice vertices, named by d integers. Splat: a point gives its values to
its vertices by barycentric weights (an explode and an aggregate). Blur: along each of the d + 1 directions a vertex takes
half of both neighbours that exist (an aggregate by vertex). Slice: a point reads its vertices back (a join). Every
step is keyed by volume and vertex, so the work of a volume spreads over all tasks and is linear in its voxels.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import co_partitioned, cut
from .volume import AXES

_c = F.col


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def scales(d: int) -> list[float]:
    """Of each feature in the lattice's hyperplane, for a blur of unit width."""
    return [math.sqrt(2 / 3) * (d + 1) / math.sqrt((i + 1) * (i + 2)) for i in range(d)]


def vertex_names(d: int) -> list[str]:
    return [f"k{i}" for i in range(d)]


def corners(points: DataFrame, ids: list[str], features: list[Column]) -> DataFrame:
    """The d + 1 vertices of each point: ids, k0 .. k(d-1), weight; weights of a point have sum 1.

    The point is turned into the hyperplane of sum zero, rounded to the nearest vertex of remainder 0, and the order of
    what is left over tells the simplex. Equal leftovers are ordered by their place.
    """
    d = len(features)
    n = d + 1
    rows = points.select(*ids, *[f.cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    rows = rows.select(*ids, *[(_c(f"f{i}") * F.lit(s)).alias(f"c{i}") for i, s in enumerate(scales(d))])
    from_ = lambda j: _sum([_c(f"c{i}") for i in reversed(range(j, d))]) if j < d else F.lit(0.0)
    rows = rows.select(*ids, *[(from_(j) - _c(f"c{j - 1}") * F.lit(float(j)) if j else from_(0)).alias(f"e{j}") for j in range(n)])
    rows = rows.select("*", *[F.rint(_c(f"e{j}") / F.lit(float(n))).cast("int").alias(f"v{j}") for j in range(n)])
    rows = rows.select("*", *[(_c(f"e{j}") - _c(f"v{j}") * n).alias(f"r{j}") for j in range(n)], _sum([_c(f"v{j}") for j in range(n)]).alias("off"))
    before = lambda i, j: (_c(f"r{j}") >= _c(f"r{i}") if j < i else _c(f"r{j}") > _c(f"r{i}")).cast("int")
    rows = rows.select("*", *[(_sum([before(i, j) for j in range(n) if j != i]) + _c("off")).alias(f"q{i}") for i in range(n)])
    # a point that was rounded off the plane comes back by whole steps
    step = lambda i: F.when(_c(f"q{i}") < 0, 1).when(_c(f"q{i}") > d, -1).otherwise(0)
    rows = rows.select(*ids, *[f"e{j}" for j in range(n)], *[(_c(f"q{i}") + step(i) * n).alias(f"rank{i}") for i in range(n)], *[((_c(f"v{i}") + step(i)) * n).alias(f"y{i}") for i in range(n)])
    left = lambda i: (_c(f"e{i}") - _c(f"y{i}")) / F.lit(float(n))
    at = lambda r: F.coalesce(*[F.when(_c(f"rank{i}") == r, left(i)) for i in range(n)])
    rows = rows.select(*ids, *[f"y{i}" for i in range(d)], *[f"rank{i}" for i in range(d)], *[at(r).alias(f"t{r}") for r in range(n)])
    weight = lambda k: _c(f"t{d - k}") - _c(f"t{d + 1 - k}") if k else F.lit(1.0) + _c(f"t{d}") - _c("t0")
    place = lambda k, i: _c(f"y{i}") + F.when(_c(f"rank{i}") <= d - k, k).otherwise(k - n)
    vertex = F.explode(F.array(*[F.struct(*[place(k, i).cast("int").alias(f"k{i}") for i in range(d)], weight(k).alias("weight")) for k in range(n)]))
    return rows.select(*ids, vertex.alias("vertex")).select(*ids, "vertex.*")


def _blurred(now: DataFrame, keys: list[str], channels: list[str], d: int) -> DataFrame:
    """Vertices blurred along each of the d + 1 directions."""
    vertex = vertex_names(d)
    for j in range(d + 1):
        moves = [F.struct(*[(_c(k) + s * (d if i == j else -1)).cast("int").alias(k) for i, k in enumerate(vertex)], F.lit(0.5 if s else 1.0).alias("share"), F.lit(s == 0).alias("own")) for s in (0, 1, -1)]
        sent = now.select(*keys, F.explode(F.array(*moves)).alias("to"), *channels).select(*keys, "to.*", *channels)
        now = sent.groupBy(*keys, *vertex).agg(*[F.sum(_c("share") * _c(c)).alias(c) for c in channels], F.max("own").alias("own")).where("own").drop("own")
    return now


def _splat_and_slice(given: DataFrame, lattice: DataFrame, keys: list[str], ids: list[str], channels: list[str], d: int) -> DataFrame:
    """given: the lattice's rows with channels."""
    vertex = vertex_names(d)
    first = given.groupBy(*keys, *vertex).agg(*[F.sum(_c("weight") * _c(c)).alias(c) for c in channels])
    taken = lattice.join(_blurred(first, keys, channels, d), [*keys, *vertex])
    return taken.groupBy(*ids).agg(*[(F.sum(_c("weight") * _c(c)) / F.lit(1.0 + 2.0**-d)).alias(c) for c in channels])


def filtered(lattice: DataFrame, values: DataFrame, keys: list[str], ids: list[str], channels: list[str], d: int) -> DataFrame:
    """ids and channels, each channel filtered on the lattice that `corners` made of the same ids."""
    return _splat_and_slice(lattice.join(values.select(*ids, *channels), ids), lattice, keys, ids, channels, d)


def filtered_points(points: DataFrame, keys: list[str], ids: list[str], features: list[Column], channels: list[str]) -> DataFrame:
    """The same for points that carry their channels and what features are made of: the lattice is never stored, its
    vertices are worked out from the points when they give and again when they take."""
    given = corners(points, [*ids, *channels], features)
    return _splat_and_slice(given, corners(points, ids, features), keys, ids, channels, len(features))


#: Points of the largest volume that is dealt to one partition as a whole, and of a partition of such volumes.
DEALT, PART = 1 << 18, 1 << 18


def softmax(logits: list[Column]) -> list[Column]:
    most = F.greatest(*logits) if len(logits) > 1 else logits[0]
    powers = [F.exp(u - most) for u in logits]
    return [p / _sum(powers) for p in powers]


def dense_crf(rows: DataFrame, keys: list[str], logits: list[str], features: list[str], alpha: float = 5.0, beta: float = 5.0, gamma: float = 5.0, rounds: int = 5, aspect: tuple[float, ...] = (1.0, 1.0, 1.0), compatibility=None, weights=None) -> DataFrame:
    """RS10: mean-field rounds of a dense CRF with a bilateral kernel (place / alpha, features / beta) and a spatial one
    (place / gamma); returns keys, x, y, z and the logits after the last round.

    Kernels are normalised by the square root of their sum on both sides. compatibility: classes x classes, by default
    minus the identity; weights: of both kernels by class, by default 1. Places enter in the order z, y, x.

    Volumes of at most DEALT voxels are dealt to partitions by their keys at the start of a round, and as every step is keyed by
    volume and more, nothing else is shuffled; rows stay rows, in sorts and aggregates that spill. Larger ones are shuffled by vertex
    and by point in each step, so that a volume spreads over all tasks. Points and logits are checkpointed between rounds,
    so that plans stay of one size.
    """
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n")))
    total, large = counts.agg(F.sum("__n"), F.count_if(_c("__n") > DEALT)).first()
    whole = dict(alpha=alpha, beta=beta, gamma=gamma, rounds=rounds, aspect=aspect, compatibility=compatibility, weights=weights)
    of = counts.where(_c("__n") > DEALT).select(*keys)
    parts = []
    if large < counts.count():
        small = rows.join(of, keys, "left_anti") if large else rows
        n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
        parts.append(_rounds(small, keys, logits, features, lambda df: df.repartition(n, *keys), **whole))
    if large or not parts:
        parts.append(_rounds(rows.join(of, keys, "left_semi") if parts else rows, keys, logits, features, lambda df: df, **whole))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _rounds(rows: DataFrame, keys: list[str], logits: list[str], features: list[str], deal: Callable[[DataFrame], DataFrame], alpha: float, beta: float, gamma: float, rounds: int, aspect: tuple[float, ...], compatibility, weights) -> DataFrame:
    """dense_crf for volumes that deal sends to partitions alike, at the start and after each checkpoint."""
    ids, n = [*keys, *AXES], len(logits)
    mu = compatibility or [[-1.0 if i == j else 0.0 for j in range(n)] for i in range(n)]
    share = weights or [[1.0] * n, [1.0] * n]
    place = [_c(a) * F.lit(float(s)) for a, s in zip(reversed(AXES), reversed(aspect), strict=True)]
    own = [f"__g{i}" for i in range(len(features))]
    kernels = [[*[p / F.lit(float(alpha)) for p in place], *[_c(g) / F.lit(float(beta)) for g in own]], [p / F.lit(float(gamma)) for p in place]]
    points = deal(rows.select(*ids, *[_c(f).alias(g) for f, g in zip(features, own, strict=True)], *[_c(u).cast("double").alias(f"u{i}") for i, u in enumerate(logits)]))
    base = points
    for k, kernel in enumerate(kernels):
        total = filtered_points(points.withColumn("one", F.lit(1.0)), keys, ids, kernel, ["one"])
        base = base.join(total.select(*ids, (1.0 / F.sqrt(_c("one") + 1e-20)).alias(f"norm{k}")), ids)
    now = base.select("*", *[_c(f"u{i}").alias(f"h{i}") for i in range(n)])
    for _ in range(rounds):
        now = deal(co_partitioned(now))
        shares = now.select("*", *[q.alias(f"q{i}") for i, q in enumerate(softmax([_c(f"h{i}") for i in range(n)]))])
        met = now.select(*base.columns)
        for k, kernel in enumerate(kernels):
            names = [f"m{k}_{i}" for i in range(n)]
            sent = shares.select(*ids, *own, *[(_c(f"q{i}") * _c(f"norm{k}")).alias(m) for i, m in enumerate(names)])
            met = met.join(filtered_points(sent, keys, ids, kernel, names), ids)
        message = [_sum([_c(f"m{k}_{i}") * F.lit(float(share[k][i])) * _c(f"norm{k}") for k in range(2)]) for i in range(n)]
        new = [(_c(f"u{j}") - _sum([message[i] * F.lit(float(mu[i][j])) for i in range(n)])).alias(f"h{j}") for j in range(n)]
        now = met.select(*base.columns, *new)
    return co_partitioned(now.select(*ids, *[_c(f"h{i}").alias(u) for i, u in enumerate(logits)]))
