"""Tiles, cells, padding, windows and augmentation against brute force on small volumes."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraymill.operators import catalog as C
from arraymill.operators import links, surface, volume, windows

AT = "k int, x int, y int, z int"


def mask_of(spark, cells):
    return spark.createDataFrame(cells, AT)


def brute_components(cells):
    left, out, number = set(cells), {}, 0
    for c in sorted(left):
        if c in out:
            continue
        number += 1
        stack = [c]
        while stack:
            x = stack.pop()
            if x in out or x not in left:
                continue
            out[x] = number
            stack += [tuple(v + d * (i == a) for i, v in enumerate(x)) for a in range(3) for d in (1, -1)]
    return out


def test_components_across_tiles(spark):
    r = random.Random(3)
    snake = [(x, 0 if x % 8 < 4 else x % 4, 1) for x in range(30)] + [(29, y, 1) for y in range(20)] + [(x, 19, 1) for x in range(5, 30)]
    volumes = {1: snake, 2: [(x, y, z) for x in range(9) for y in range(9) for z in range(9) if r.random() < 0.4], 3: [(0, 0, 0)], 4: [(x, y, 0) for x in range(12) for y in range(12)]}
    df = mask_of(spark, [(k, *c) for k, cells in volumes.items() for c in set(cells)])
    want = {(k, *c): n for k, cells in volumes.items() for c, n in brute_components(cells).items()}
    for tile in (4, 5, 64):
        got = {tuple(row)[:4]: row.component for row in surface.components(df, ["k"], tile).select("k", "x", "y", "z", "component").collect()}
        assert got == want, tile


def test_roots_of_long_chains_and_groups(spark):
    r = random.Random(5)
    edges = [(1, i, i + 1) for i in range(60)] + [(2, i, 100 + i % 3) for i in range(30)] + [(2, 7, 7), (2, None, 3), (3, 5, 5)]
    r.shuffle(edges)
    got = {(row.k, row.node): row.root for row in links.roots(spark.createDataFrame(edges, "k int, u long, v long"), ["k"]).collect()}
    assert {n: got[1, n] for n in range(61)} == dict.fromkeys(range(61), 0)
    assert {got[2, n] for n in (*range(30), 100, 101, 102)} == {0, 1, 2}
    assert all(got[2, n] == n % 3 for n in range(30))
    assert not [k for k in got if k[0] == 3]
    assert links.roots(spark.createDataFrame([], "k int, u long, v long"), ["k"]).count() == 0


@pytest.mark.parametrize(("cell", "pixdim"), [(2, (1.0, 1.0, 1.0)), (3, (1.0, 2.5, 0.4)), (8, (0.5, 1.0, 3.0))])
def test_border_distances_near_and_far(spark, cell, pixdim):
    r = random.Random(7)
    spot = lambda low, high: tuple(r.randint(low, high) for _ in range(3))
    a = {1: {spot(0, 6) for _ in range(40)} | {(40, 41, 3)}, 2: {spot(0, 30) for _ in range(30)}, 3: {(0, 0, 0)}, 4: {(1, 1, 1)}}
    b = {1: {spot(3, 9) for _ in range(40)}, 2: {(60, 2, 2), (0, 70, 9)}, 3: {(0, 0, 0)}, 5: {(1, 1, 1)}}
    frame = lambda m: mask_of(spark, [(k, *c) for k, cells in m.items() for c in cells])
    got = {tuple(row)[:4]: row.distance for row in surface.border_distances(frame(a), frame(b), ["k"], pixdim, cell).collect()}
    want = {(k, *p): min(math.dist([v * s for v, s in zip(p, pixdim)], [v * s for v, s in zip(q, pixdim)]) for q in b[k]) for k, cells in a.items() if k in b for p in cells}
    assert got == pytest.approx(want)


def operators_of(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_plans_pair_cells_and_explode_no_axis(spark):
    m = mask_of(spark, [(1, 0, 0, 0)])
    plan = operators_of(surface.border_distances(m, m, ["k"]))
    # the only join by group alone is that of boxes; voxels are joined by cell
    keyed = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[([^\]]*)\]", plan)
    assert sum(keys.count(",") == 0 for keys in keyed) == 1
    assert sum(keys.count(",") == 3 for keys in keyed) == 2
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    vox = spark.createDataFrame([(1, 0, 0, 0, 1.0)], AT + ", value double")
    for mode in ("edge", "wrap", "symmetric", "reflect"):
        far = volume.pad(vox, ["k"], (1000, 1, 1), (2, 0, 0), mode)
        assert far.count() <= 3  # one voxel: its own place and those of the border that show it
        assert max((len(x) for x in re.findall(r"\[([-\d, ]+)\]", operators_of(far))), default=0) < 20  # no list of places in the plan
    sizes = spark.createDataFrame([(1, 1000, 1, 1)], "k int, X int, Y int, Z int")
    rows = windows.cut_windows(vox, sizes, "k", (4, 1, 1))
    assert rows.count() == 1
    assert "posexplode" not in operators_of(rows)


@pytest.mark.parametrize("mode", ["edge", "wrap", "symmetric", "reflect"])
@pytest.mark.parametrize(("n", "before", "after"), [(4, 2, 3), (3, 7, 8), (2, 5, 1), (1, 3, 3)])
def test_padding_as_numpy_does(spark, mode, n, before, after):
    line = np.arange(n) + 10.0
    vox = spark.createDataFrame([(1, i, 0, 0, float(v)) for i, v in enumerate(line)], AT + ", value double")
    got = volume.pad(vox, ["k"], (n, 1, 1), (before, 0, 0), mode, after=(after, 0, 0)).orderBy("x").collect()
    assert [r.x for r in got] == list(range(n + before + after))
    assert [r.value for r in got] == np.pad(line, (before, after), mode).tolist()


@pytest.mark.parametrize("window", [2, 3, 5])
@pytest.mark.parametrize("step", [1, 2, 4])
def test_covering_windows_are_those_of_the_grid(spark, window, step):
    for end in range(window, 14):
        starts = windows.step_points(end, window, step)
        if step > window:
            continue  # steps are at most the window: windows leave no gaps
        rows = spark.range(end).select("id", F.explode(windows.covering(F.col("id"), F.lit(end), window, step)).alias("i"))
        got = {(r.id, r.i, r.s) for r in rows.select("id", "i", windows.start_of(F.col("i"), F.lit(end), window, step).alias("s")).collect()}
        assert got == {(p, i, s) for p in range(end) for i, s in enumerate(starts) if s <= p < s + window}, end


def test_corner_affine_is_the_least_squares_fit():
    shape = (4, 6, 9)
    for scale, seed in ((0.0, 1), (0.3, 2), (1.0, 3), (5.0, 3)):
        rng = random.Random(seed)
        corners = [(a, b, c) for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
        moved = [[v * rng.uniform(1 - min(scale, 1.0), 1.0) for v in c] for c in corners]
        fit, *_ = np.linalg.lstsq(np.c_[np.array(corners), np.ones(8)], np.array(moved), rcond=None)
        got = np.array(volume.corner_affine(shape, scale, seed))
        for p in ((0, 0, 0), (3, 5, 8), (1, 2, 3.5)):
            relative = np.array(p) / (np.array(shape) - 1) * 2 - 1
            want = (np.r_[relative, 1] @ fit + 1) / 2 * (np.array(shape) - 1)
            assert got[:, :3] @ np.array(p) + got[:, 3] == pytest.approx(want)
    assert np.array(volume.corner_affine(shape, 0.0, 9)) == pytest.approx(np.eye(4)[:3])


def test_constraints_of_affines():
    a = volume.AffineConstraints(((None, 0.0, 0.0, 0.0), (0.0, None, 0.0, 0.0), (0.0, 0.0, None, 0.0)))
    b = volume.AffineConstraints(((2.0, None, None, None), (None,) * 4, (None,) * 4))
    both = a & b
    assert (a.free, b.free, both.free) == (3, 11, 2)
    assert both.matrix([3.0, 4.0]) == [[2.0, 0.0, 0.0, 0.0], [0.0, 3.0, 0.0, 0.0], [0.0, 0.0, 4.0, 0.0]]
    with pytest.raises(ValueError, match="disagree"):
        a & volume.AffineConstraints(((None, 1.0, None, None), (None,) * 4, (None,) * 4))
    with pytest.raises(ValueError, match="2 parameters are free"):
        both.matrix([1.0])


def test_scaling_smooths_before_it_shrinks(spark):
    """The mirrored gaussian against a sum over the whole mirrored line, and no smoothing unless all axes shrink."""
    assert volume.antialias_sigma((0.5, 1.0, 0.5)) is None
    sigma = volume.antialias_sigma((0.5, 0.5, 0.5))
    assert sigma == pytest.approx((math.sqrt(3) / (2 * math.sqrt(2 * math.log(2))),) * 3)
    r = np.random.default_rng(4)
    a = r.normal(size=(5, 4, 3))
    vox = spark.createDataFrame([(1, *map(int, i), float(a[i])) for i in np.ndindex(a.shape)], AT + ", value double")
    got = np.zeros(a.shape)
    for row in volume.smooth_reflected(vox, ["k"], a.shape, sigma).collect():
        got[row.x, row.y, row.z] = row.value
    want = a
    for axis in range(3):
        tail = int(4 * sigma[axis] + 0.5)
        w = np.exp(-0.5 * (np.arange(-tail, tail + 1) / sigma[axis]) ** 2)
        lines = np.pad(want, [(tail, tail) if i == axis else (0, 0) for i in range(3)], "symmetric")
        want = np.apply_along_axis(lambda v: np.convolve(v, w / w.sum(), "valid"), axis, lines)
    assert got == pytest.approx(want)
    small = volume.rescaled(vox, ["k"], a.shape, (0.6, 0.75, 0.67))
    assert small.count() == 3 * 3 * 2
    assert len(set(volume.random_zoom(-20, 20, 1))) == 3 and len(set(volume.random_zoom(-20, 20, 1, isotropic=True))) == 1
    assert all(0.8 <= z <= 1.2 for z in volume.random_zoom(-20, 20, 1))


def brute_match(left, right):
    def longest(a, b):
        return max((k for i in range(len(a)) for k in range(1, len(a) - i + 1) if a[i : i + k] in b), default=0)

    out = set()
    for i, a in left:
        scored = [(longest(a, b), longest(a, b) / len(b), j) for j, b in right if b]
        best = max(((s, q) for s, q, _ in scored if s), default=None)
        hit = [j for s, q, j in scored if (s, q) == best]
        if best and len(hit) == 1:
            out.add((i, hit[0], best[0]))
    return out


def test_fuzzy_matches_of_any_length(spark):
    r = random.Random(2)
    name = lambda: "subject_" * (r.random() < 0.5) + "".join(r.choice("ab1") for _ in range(r.randint(0, 7)))
    left, right = [(i, name()) for i in range(60)] + [(100, "q"), (101, None), (102, "")], [(i, name()) for i in range(40)] + [(70, "zq"), (71, None)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, name string")
    got = {tuple(x) for x in C.fuzzy_match(frame(left), frame(right)).collect()}
    assert got == brute_match([x for x in left if x[1]], [x for x in right if x[1]])
    assert (100, 70, 1) in got
    assert C.fuzzy_match(frame(left), frame(right).where("false")).count() == 0
