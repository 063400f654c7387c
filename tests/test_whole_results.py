"""Whole results where an earlier query returned or compared a part only."""

import numpy as np
import pytest

from arraymill.operators import catalog as C
from arraymill.operators import intensity as I
from arraymill.operators import splines as Z
from arraymill.plans.queries import QUERIES

from .conftest import SF


def volume(spark, a):
    return spark.createDataFrame([(7, *map(int, p), float(a[p])) for p in np.ndindex(a.shape)], "k int, x int, y int, z int, value double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.x, r.y, r.z] = r.value
    return out


def brute_spline(v, t):
    """The cubic spline through v, mirrored at both ends, at t: pieces with second derivatives solved for."""
    n = len(v)
    at = lambda i: v[abs(i) if i < n else 2 * n - 2 - i]
    m, rhs = np.zeros((n, n)), np.zeros(n)
    for i in range(n):
        for j, w in ((i - 1, 1 / 6), (i, 4 / 6), (i + 1, 1 / 6)):
            m[i, abs(j) if j < n else 2 * n - 2 - j] += w
        rhs[i] = at(i - 1) - 2 * at(i) + at(i + 1)
    bend = np.linalg.solve(m, rhs)
    i = min(int(t), n - 2)
    u = t - i
    return (1 - u) * v[i] + u * v[i + 1] + ((1 - u) ** 3 - (1 - u)) * bend[i] / 6 + (u**3 - u) * bend[i + 1] / 6


@pytest.mark.parametrize(("shape", "to"), [((4, 3, 2), (7, 5, 3)), ((4, 4, 4), (7, 6, 9))])
def test_zoom_cubic_at_every_voxel(spark, shape, to):
    a = np.random.default_rng(3).normal(size=shape)
    want = a
    for axis, (n, m) in enumerate(zip(shape, to, strict=True)):
        want = np.apply_along_axis(lambda v, n=n, m=m: np.array([brute_spline(v, p * (n - 1) / (m - 1)) for p in range(m)]), axis, want)
    got = array(Z.zoom_cubic(volume(spark, a), ["k"], shape, to), to)
    assert np.allclose(got, want)


def test_zoom_query_returns_the_interpolated_voxels(spark):
    counts = QUERIES["vox_zoom_cubic_all"](spark, SF).groupBy("vec_id").count().collect()
    assert counts and {r["count"] for r in counts} == {343}


def test_index_transforms_of_every_voxel(spark):
    rows = QUERIES["vox_index_transforms_all"](spark, SF).select("vec_id", "x", "rx").collect()
    assert len(rows) == 64 * len({r.vec_id for r in rows})
    assert {(r.x, r.rx) for r in rows} == {(0, 0), (1, 2), (2, 5), (3, 7)}


def test_fuzzy_match_of_short_names_and_overlaps(spark):
    right = [(1, "T1"), (2, "T1_weighted"), (3, "12"), (4, "abcd"), (5, "xbcd"), (6, "q"), (7, "qq"), (8, "T2"), (9, ""), (10, None)]
    left = [(1, "T1"), (2, "12"), (3, "9T1x"), (4, "_bcd"), (5, "zqz"), (6, "weight"), (7, "T"), (8, "~"), (9, ""), (10, None), (11, "1"), (12, "x.d"), (13, "qq")]

    def size(a, b):
        return max((k for i in range(len(a)) for k in range(1, len(a) - i + 1) if a[i : i + k] in b), default=0)

    want = set()
    for i, a in left:
        scores = [(size(a or "", b or ""), size(a or "", b or "") / len(b) if b else 0, j) for j, b in right]
        top = [s for s in scores if s[:2] == max(scores)[:2]]
        if top[0][0] and len(top) == 1:
            want.add((i, top[0][2], top[0][0]))
    got = C.fuzzy_match(spark.createDataFrame(left, "id int, name string"), spark.createDataFrame(right, "id int, name string"))
    assert {tuple(r) for r in got.collect()} == want
    assert {(1, 1, 2), (2, 3, 2), (3, 1, 2), (5, 6, 1)} <= want
    nested = [spark.createDataFrame(x, "id int, name string").selectExpr("id", "array(name) AS candidates") for x in ([(1, "aT1")], [(5, "T1")])]
    assert [tuple(r) for r in C.match_all(nested).collect()] == [(1, 5)]


def test_regions_of_one_value_and_without_spread(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (2, 3.0), (3, 1.0), (3, 2.0)], "k int, v double")
    stats = {r.k: (r["min"], r["max"], r["mean"], r["std"], r["skewness"], r["kurtosis"], r["median"]) for r in I.region_stats(df, ["k"], "v").collect()}
    assert stats[1] == (5, 5, 5, 0, None, None, 5) and stats[2] == (3, 3, 3, 0, None, None, 3) and stats[3][3] == 0.5
    assert {r.k: (r.q25, r.q75) for r in I.mquantiles(df, ["k"], "v").where("k < 3").collect()} == {1: (5, 5), 2: (3, 3)}


def test_region_and_pair_queries_return_every_group(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_returnflag", "l_suppkey").distinct().count()
    assert QUERIES["region_stats_all"](spark, SF).count() == QUERIES["region_mquantiles_all"](spark, SF).count() == lines
    ordered = {r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().collect()}
    assert {r.c_custkey for r in QUERIES["pairwise_windows_all"](spark, SF).collect()} == ordered


def test_elastic_moves_voxels_as_brute_force_does(spark):
    shape, controls, sigma, seed, key = (3, 4, 2), 4, 0.7, 5, 7
    a = np.random.default_rng(1).normal(size=shape)
    got = array(Z.elastic(volume(spark, a), ["k"], shape, controls, sigma, seed), shape)
    rng = np.random.default_rng([seed, key])
    fields = [rng.normal(0, sigma, (controls,) * 3) for _ in shape]

    def spline(field, p):
        for n, i in zip(shape, p, strict=True):  # the first axis left, each time
            t = i * (controls - 1) / (n - 1)
            field = np.apply_along_axis(brute_spline, 0, field, t)
        return float(field)

    def linear(p):
        if not p:
            return lambda b: float(b)
        t = min(max(p[0], 0), shape[3 - len(p)] - 1)
        low = int(t)
        return lambda b: (1 - (t - low)) * linear(p[1:])(b[low]) + (t - low) * (linear(p[1:])(b[low + 1]) if t > low else 0)

    want = np.zeros(shape)
    for p in np.ndindex(shape):
        want[p] = linear([i + spline(f, p) for i, f in zip(p, fields, strict=True)])(a)
    assert np.allclose(got, want)
    assert np.abs(got - a).max() > 0.1


def test_crf_against_loops(spark):
    shape, rounds, width, contrast, weight = (2, 2, 2), 3, 0.8, 0.6, 1.5
    a = np.random.default_rng(2).normal(size=shape)
    got = array(Z.crf(volume(spark, a), ["k"], shape, rounds, width, contrast, weight), shape)
    at = list(np.ndindex(shape))
    kernel = {(i, j): np.exp(-sum((x - y) ** 2 for x, y in zip(i, j, strict=True)) / (2 * width**2)) * np.exp(-((a[i] - a[j]) ** 2) / (2 * contrast**2)) for i in at for j in at if i != j}
    q = {i: 1 / (1 + np.exp(-a[i])) for i in at}
    for _ in range(rounds):
        new = {}
        for i in at:
            total = sum(kernel[i, j] for j in at if j != i)
            message = sum(kernel[i, j] / total * (q[j] - (1 - q[j])) for j in at if j != i)
            new[i] = 1 / (1 + np.exp(-(a[i] + weight * message)))
        q = new
    assert np.allclose(got, [[[q[x, y, z] for z in range(2)] for y in range(2)] for x in range(2)])
    assert np.abs(got - 1 / (1 + np.exp(-a))).max() > 0.01
