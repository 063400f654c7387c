"""The separable distance transform against all pairs."""

import numpy as np
import pytest

from arraymill.operators import surface


def frame(spark, points):
    return spark.createDataFrame([(k, *map(int, p)) for k, ps in points.items() for p in ps], "k int, x int, y int, z int")


@pytest.mark.parametrize("pixdim", [(1.0, 1.0, 1.0), (0.5, 2.0, 1.25)])
def test_distances_of_scattered_points(spark, pixdim):
    """Groups of one to many points, negative places, lines without points, sides that overlap, and a group of one side."""
    rng = np.random.default_rng(4)
    a = {1: rng.integers(-6, 20, (80, 3)), 2: rng.integers(0, 3, (9, 3)), 3: np.array([[100, -50, 7]]), 4: np.array([[0, 0, 0]])}
    b = {1: rng.integers(-20, 9, (60, 3)), 2: a[2][:4], 3: rng.integers(0, 30, (5, 3)), 5: np.array([[1, 1, 1]])}
    a = {k: np.unique(v, axis=0) for k, v in a.items()}
    got = {(r.k, r.x, r.y, r.z): r.distance for r in surface.field_distances(frame(spark, a), frame(spark, b), ["k"], pixdim).collect()}
    want = {(k, *map(int, p)): np.sqrt((((b[k] - p) * pixdim) ** 2).sum(axis=1).min()) for k in (1, 2, 3) for p in a[k]}
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(d) for p, d in want.items())


@pytest.mark.parametrize("seed", range(5))
def test_envelope(seed):
    rng = np.random.default_rng(seed)
    places = np.sort(rng.choice(40, rng.integers(1, 25), replace=False) - 10)
    values, weight = rng.choice([0.0, 1.0, 4.5, 30.0, 400.0], len(places)), float(rng.choice([0.25, 1.0, 7.0]))
    got = surface._envelope(places.tolist(), values.tolist(), weight, -15, 45)
    assert np.allclose(got, (values + weight * (np.arange(-15, 46)[:, None] - places) ** 2).min(axis=1))


def test_a_subject_is_no_key_of_its_own(spark):
    """Groups and joins of many rows are by line or voxel; by subject alone only its one row of bounds is joined."""
    m = frame(spark, {1: [[0, 0, 0], [5, 5, 5]]})
    plan = surface.field_distances(m, m, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Cross" not in plan
    assert plan.count("Join Inner") == 2
