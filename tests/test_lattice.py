"""The permutohedral filter and the dense CRF against a brute-force lattice and against exact gaussian kernels."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraymill.operators import lattice as L


def simplex(f):
    """[(vertex, weight)] of one point, by moving what was rounded most until the rounded point lies in the plane."""
    d = len(f)
    c = [x * (math.sqrt(2 / 3) * (d + 1) / math.sqrt((i + 1) * (i + 2))) for i, x in enumerate(f)]
    tails = [0.0]
    for x in reversed(c):  # sums from the last on, so that points of equal coordinates tie as they do there
        tails.append(tails[-1] + x)
    e = np.array([tails[d - j] - j * c[j - 1] if j else tails[d] for j in range(d + 1)])
    y = np.rint(e / (d + 1)) * (d + 1)
    while y.sum() > 0.5:  # off the plane: what was rounded up most comes down, the last of equals
        y[max(range(d + 1), key=lambda i: (y[i] - e[i], i))] -= d + 1
    while y.sum() < -0.5:  # and what was rounded down most goes up, the first of equals
        y[max(range(d + 1), key=lambda i: (e[i] - y[i], -i))] += d + 1
    order = np.argsort(-(e - y), kind="stable")
    t = (e - y)[order] / (d + 1)
    out = []
    for k in range(d + 1):
        v = y.copy()
        for r, i in enumerate(order):
            v[i] += k if r <= d - k else k - (d + 1)
        out.append((tuple(int(round(x)) for x in v), t[d - k] - t[d + 1 - k] if k else 1 + t[d] - t[0]))
    return out


def brute_filter(points, values):
    d = len(points[0])
    made = [simplex(p) for p in points]
    table = defaultdict(float)
    for m, v in zip(made, values, strict=True):
        for k, w in m:
            table[k] += w * v
    for j in range(d + 1):
        off = np.array([d if i == j else -1 for i in range(d + 1)])
        table = {k: v + 0.5 * (table.get(tuple(np.array(k) + off), 0.0) + table.get(tuple(np.array(k) - off), 0.0)) for k, v in table.items()}
    return [sum(table[k] * w for k, w in m) / (1 + 2.0**-d) for m in made]


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_filter_against_a_brute_force_lattice(spark, d):
    rng = np.random.default_rng(d)
    points, values = rng.normal(0, 2, (60, d)), rng.normal(size=60)
    df = spark.createDataFrame([(1, i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(points, values, strict=True))], ["k", "i", *[f"a{j}" for j in range(d)], "v"])
    lattice = L.corners(df, ["k", "i"], [F.col(f"a{j}") for j in range(d)])
    sums = lattice.groupBy("i").agg(F.sum("weight").alias("s"), F.min("weight").alias("least"), F.count("*").alias("n")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.least > -1e-9 and r.n == d + 1 for r in sums)
    got = {r.i: r.v for r in L.filtered(lattice, df, ["k"], ["k", "i"], ["v"], d).collect()}
    assert np.allclose([got[i] for i in range(60)], brute_filter(points, values))


def test_filter_is_close_to_the_exact_kernel(spark):
    """Averages by the lattice's kernel stay near those of the gaussian, on a dense grid of places and one feature."""
    rng = np.random.default_rng(1)
    at = np.array([(x, y, float(x > 5)) for x in range(12) for y in range(12)]) / [2.0, 2.0, 0.5]
    v = rng.normal(size=len(at)) + 3 * (at[:, 2] > 0)
    df = spark.createDataFrame([(1, i, *map(float, p), float(x), 1.0) for i, (p, x) in enumerate(zip(at, v, strict=True))], "k long, i long, a double, b double, c double, v double, one double")
    lattice = L.corners(df, ["k", "i"], [F.col(c) for c in "abc"])
    got = {r.i: r.v / r.one for r in L.filtered(lattice, df, ["k"], ["k", "i"], ["v", "one"], 3).collect()}
    kernel = np.exp(-((at[:, None] - at[None]) ** 2).sum(-1) / 2)
    want = kernel @ v / kernel.sum(axis=1)
    assert np.abs(np.array([got[i] for i in range(len(at))]) - want).max() < 0.25 * want.std()


def test_crf_against_loops(spark):
    """Two volumes of different shapes, three classes, own compatibilities and weights."""
    rng = np.random.default_rng(2)
    alpha, beta, gamma, aspect = 1.7, 0.6, 1.2, (1.0, 1.0, 2.0)
    mu, w = rng.normal(size=(3, 3)), rng.uniform(0.5, 1.5, (2, 3))
    rows, want = [], {}
    for key, shape in ((1, (3, 2, 3)), (2, (2, 2, 1))):
        u, f = rng.normal(size=(*shape, 3)), rng.normal(size=shape)
        at = list(np.ndindex(shape))
        rows += [(key, *p, *map(float, u[p]), float(f[p])) for p in at]
        place = [tuple(c * s for c, s in zip(reversed(p), reversed(aspect), strict=True)) for p in at]
        kernels = [[(*[c / alpha for c in q], f[p] / beta) for p, q in zip(at, place, strict=True)], [tuple(c / gamma for c in q) for q in place]]
        norms = [1 / np.sqrt(np.array(brute_filter(k, [1.0] * len(at))) + 1e-20) for k in kernels]
        flat = np.array([u[p] for p in at])
        h = flat
        for _ in range(2):
            q = np.exp(h - h.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            total = sum(np.array([brute_filter(k, q[:, c] * n) for c in range(3)]).T * w[i] * n[:, None] for i, (k, n) in enumerate(zip(kernels, norms, strict=True)))
            h = flat - total @ mu
        want |= {(key, *p): h[i] for i, p in enumerate(at)}
    df = spark.createDataFrame(rows, "k long, x int, y int, z int, a double, b double, c double, f double")
    got = L.dense_crf(df, ["k"], ["a", "b", "c"], ["f"], alpha, beta, gamma, 2, aspect, mu.tolist(), w.tolist()).collect()
    assert len(got) == len(want)
    assert all(np.allclose([r.a, r.b, r.c], want[r.k, r.x, r.y, r.z]) for r in got)
