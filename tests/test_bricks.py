"""Bricks against sums over all corners, on volumes with gaps that reach over several bricks, and the shuffles of a zoom."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from arraymill.operators import volume as V

KIND = "k int, x int, y int, z int, value double"


def gappy(shape, seed, share=0.8):
    r = random.Random(seed)
    return {c: r.uniform(-1, 1) for c in itertools.product(*map(range, shape)) if r.random() < share}


def brute(cells, shape, point, mode="replicate"):
    base = [math.floor(p) for p in point]
    total = 0.0
    for off in itertools.product((0, 1), repeat=3):
        w = math.prod(p - b if o else 1 - (p - b) for o, p, b in zip(off, point, base, strict=True))
        at = [b + o for o, b in zip(off, base, strict=True)]
        if mode == "replicate":
            at = [min(max(i, 0), n - 1) for i, n in zip(at, shape, strict=True)]
        total += w * cells.get(tuple(at), 0.0)
    return total


@pytest.mark.parametrize("own", [False, True])
def test_zoom_over_bricks(spark, own):
    shapes = {1: (19, 3, 9), 2: (1, 17, 8), 3: (8, 8, 8)} if own else {1: (19, 3, 9), 2: (19, 3, 9)}
    volumes = {k: gappy(s, k, 1.0 if k == 3 else 0.3 * k) for k, s in shapes.items()}
    volumes[1] = {c: v for c, v in volumes[1].items() if not 7 <= c[0] <= 17}  # a whole brick without voxels
    rows = [(k, *c, v, *shapes[k]) for k, cells in volumes.items() for c, v in cells.items()]
    df = spark.createDataFrame(rows, KIND + ", nx int, ny int, nz int")
    keys, shape = V.sized(["k"]) if own else (["k"], shapes[1])
    for order, size in ((1, lambda n: 2 * n + 1), (1, lambda n: 0 * n + 4), (1, lambda n: 0 * n + 1), (0, lambda n: n + 2)):
        got = {(r.k, r.x, r.y, r.z): r.value for r in V.zoom(df, keys, shape, tuple(map(size, shape)), order).collect()}
        want = {}
        for k, cells in volumes.items():
            n, t = shapes[k], [size(i) for i in shapes[k]]
            for o in itertools.product(*map(range, t)):
                p = [i * ((a - 1) / (b - 1) if b > 1 else 0.0) for i, a, b in zip(o, n, t, strict=True)]
                want[(k, *o)] = brute(cells, n, p) if order else cells.get(tuple(min(round(q), a - 1) for q, a in zip(p, n, strict=True)), 0.0)
        assert got.keys() == want.keys()
        assert max(abs(got[c] - want[c]) for c in want) < 1e-9


@pytest.mark.parametrize("mode", ["replicate", "zero"])
def test_points_over_bricks(spark, mode):
    shape = (17, 5, 9)
    cells, r = gappy(shape, 5), random.Random(6)
    df = spark.createDataFrame([(1, *c, v) for c, v in cells.items()], KIND)
    points = [tuple(r.uniform(-3, n + 3) for n in shape) for _ in range(300)] + [(0.0, 0.0, 0.0), (16.0, 4.0, 8.0), (8.0, 4.0, 7.5), (-1.0, 2.0, 8.5)]
    ps = spark.createDataFrame([(1, i, *p) for i, p in enumerate(points)] + [(2, 0, 1.0, 1.0, 1.0), (1, 999, None, 1.0, 1.0)], "k int, i int, px double, py double, pz double")
    got = {(q.k, q.i): q.value for q in V.resample_linear(df, ps, ["k"], shape, mode).collect()}
    assert len(got) == len(points) + 2
    assert got[2, 0] == 0 and got[1, 999] is None
    assert max(abs(got[1, i] - brute(cells, shape, p, mode)) for i, p in enumerate(points)) < 1e-9


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_zoom_shuffles_voxels_once(spark):
    df = spark.createDataFrame([(1, *c, 1.0) for c in itertools.product(range(4), repeat=3)], KIND)
    assert exchanges(V.zoom(df, ["k"], (4, 4, 4), (7, 7, 7), 1)) == 1
