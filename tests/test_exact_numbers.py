"""Small cases with numbers known in advance."""

import math

import pytest
from pyspark.sql import functions as F

from arraymill.functions import strings as S
from arraymill.operators import catalog as C
from arraymill.operators import confusion as M
from arraymill.operators import control, intensity, losses, surface, volume, windows
from arraymill.plans import spec


def test_overlap_case(spark):
    """Ten voxels: 3 hits, 2 false, 1 missed, 4 right zeros."""
    pairs = [(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 4
    df = spark.createDataFrame(pairs, "seg int, ref int")
    r = M.overlap_metrics(M.confusion(df, [], F.col("seg") == 1, F.col("ref") == 1)).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.n_pos_ref, r.n_neg_ref, r.n_pos_seg, r.n_neg_seg, r.n_union, r.n_intersection) == (3, 2, 1, 4, 4, 6, 5, 5, 6, 3)
    want = {"sensitivity": 3 / 4, "specificity": 4 / 6, "accuracy": 7 / 10, "false_positive_rate": 2 / 6, "positive_predictive_values": 3 / 5, "negative_predictive_values": 4 / 5, "dice": 6 / 9, "jaccard": 3 / 6, "informedness": 3 / 4 + 4 / 6 - 1, "markedness": 3 / 5 + 4 / 5 - 1, "vol_ratio": 5 / 4, "vol_diff_rel": 1 / 4}
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: r[k] for k in want}


def test_overlap_of_empty_and_undefined(spark):
    df = spark.createDataFrame([], "k int, seg int, ref int")
    assert M.overlap_metrics(M.confusion(df, ["k"], F.col("seg") == 1, F.col("ref") == 1)).count() == 0
    none = spark.createDataFrame([(1, 0, 0), (1, None, 1)], "k int, seg int, ref int")
    r = M.overlap_metrics(M.confusion(none, ["k"], F.col("seg") == 1, F.col("ref") == 1)).first()
    assert (r.tn, r.tp, r.dice, r.sensitivity) == (1, 0, None, None)


def test_roc_and_accuracy(spark):
    """Nine rows; by hand: thresholds k / 9, so that 0.05 is over the first only, 0.2 over two, and so on."""
    rows = [(1, 0.05), (0, 0.05), (0, 0.2), (0, 0.2), (1, 0.5), (0, 0.5), (1, 0.7), (1, 0.95), (1, 0.95)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, y int, p double")
    t = {r.point: r for r in M.roc_table(df, ["k"], F.col("p"), F.col("y") == 1).collect()}
    over = lambda k, y: sum(p > k / 9 for c, p in rows if c == y)
    assert {k: (r.tp, r.fp, r.fn, r.tn) for k, r in t.items()} == {k: (over(k, 1), over(k, 0), 5 - over(k, 1), 4 - over(k, 0)) for k in range(10)}
    curve = [(over(k, 0) / 4, over(k, 1) / 5) for k in range(9, -1, -1)]
    area = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(curve, curve[1:]))
    assert M.roc_auc(df, ["k"], F.col("p"), F.col("y") == 1).first().auc == pytest.approx(area)
    # by hand, the points are (0, 0), (0, 0.4), (0, 0.6), (0.25, 0.8), (0.75, 0.8), (1, 1)
    assert area == pytest.approx(0.25 * 0.7 + 0.5 * 0.8 + 0.25 * 0.9)
    hard = M.accuracy(df, ["k"], (F.col("p") > 0.6).cast("int"), F.col("y")).first()
    assert hard.accuracy == pytest.approx(7 / 9)


def test_regression(spark):
    out, ref = [2.0, -1.0, 0.5, 4.0, 3.0], [1.5, -1.0, 1.5, 2.0, 3.5]
    df = spark.createDataFrame([(1, a, b) for a, b in zip(out, ref, strict=True)], "k int, o double, r double")
    r = M.regression(df, ["k"], F.col("o"), F.col("r")).first()
    gap = [a - b for a, b in zip(out, ref, strict=True)]  # 0.5, 0, -1, 2, -0.5
    assert (r.mse, r.rmse, r.mae) == (pytest.approx(5.5 / 5), pytest.approx(math.sqrt(1.1)), pytest.approx(sum(map(abs, gap)) / 5))
    mo, mr = sum(out) / 5, sum(ref) / 5
    cov, vo, vr = (sum((a - x) * (b - y) for a, b in zip(u, v, strict=True)) for u, v, x, y in ((out, ref, mo, mr), (out, out, mo, mo), (ref, ref, mr, mr)))
    assert r.r2 == pytest.approx((cov / math.sqrt(vo * vr + 1e-5)) ** 2)


@pytest.mark.parametrize(("args", "want"), [((10, 4, 1), [0, 1, 2, 3, 4, 5, 6]), ((10, 4, 2), [0, 2, 4, 6]), ((0, 4, 2), [0]), ((0, 0, -1), [0]), ((10, 8, 8), [0, 2, 1])])
def test_steps(spark, args, want):
    assert windows.step_points(*args) == want
    end, win, step = args
    if step > 0:
        assert spark.range(1).select(windows.step_points_column(F.lit(end), win, step)).first()[0] == want


def test_grid(spark):
    image = lambda n: spark.createDataFrame([(1, *n)], "k int, X int, Y int, Z int")
    assert windows.grid_windows(image((64, 64, 64)), "k", (63, 63, 40), (2, 3, 4)).count() == 12
    label = windows.grid_windows(image((42, 42, 42)), "k", (42, 41, 33), (2, 3, 4)).orderBy("seq").collect()
    assert len(label) == 6
    assert [r.z0 for r in label[:3]] == [0, 9, 4]
    assert windows.grid_windows(image((42, 42, 1)), "k", (30, 32, 1), (2, 3, 4)).count() == 9
    with pytest.raises(ValueError):
        windows.grid_windows(image((4, 4, 4)), "k", (5, 4, 4))


def test_border_minus_one_is_zero(spark):
    image = spark.createDataFrame([(1, 64, 64, 64)], "k int, X int, Y int, Z int")
    rows = lambda b: sorted(map(tuple, windows.grid_windows(image, "k", (30, 30, 40), b).collect()))
    assert rows((-1, -1, -1)) == rows((0, 0, 0))


def test_surface_distances(spark):
    """Two short bars of the same line, three voxels and two, five apart: every voxel is border."""
    mask = lambda xs: spark.createDataFrame([(1, x, 4, 2) for x in xs], "k int, x int, y int, z int")
    r = surface.surface_distances(mask([0, 1, 2]), mask([7, 8]), ["k"], (2.0, 1.0, 1.0)).first()
    there, back = [14.0, 12.0, 10.0], [10.0, 12.0]  # to 7 from 0, 1, 2; to 2 from 7, 8; voxels are 2 long
    assert r.average_distance == pytest.approx((sum(there) + sum(back)) / 5)
    assert r.hausdorff_distance == pytest.approx(14.0)
    assert r.hausdorff95_distance == pytest.approx(max(12.0 + 0.9 * 2.0, 10.0 + 0.95 * 2.0))
    one = spark.createDataFrame([(1, 5, 5, 5)], "k int, x int, y int, z int")
    assert [tuple(x) for x in surface.border(one, ["k"]).collect()] == [(1, 5, 5, 5)]


def test_regression_losses(spark):
    out, ref, w = [0.5, 2.0, -1.0, 4.0, 3.0], [0.0, 2.25, 1.5, 1.0, 3.0], [1.0, 0.5, 2.0, 0.25, 3.0]

    def loss(weights):
        df = spark.createDataFrame([(1, *x) for x in zip(out, ref, w, strict=True)], "k int, o double, r double, w double")
        return losses.regression_losses(df, ["k"], F.col("o"), F.col("r"), F.col("w") if weights else None).first()

    gap = [abs(a - b) for a, b in zip(out, ref, strict=True)]  # 0.5, 0.25, 2.5, 3, 0
    assert loss(False).l1 == pytest.approx(sum(gap) / 5)
    assert loss(True).l1 == pytest.approx(sum(x * y for x, y in zip(gap, w, strict=True)) / sum(w))
    assert loss(False).l2 == pytest.approx(sum(x * x for x in gap) / 2)
    assert loss(False).huber == pytest.approx(sum(x * x / 2 if x <= 1 else x - 0.5 for x in gap) / 5)


def classes(spark, p, truth, w=None, softmax=True):
    df = spark.createDataFrame([(1, i, [float(x) for x in a], g, float(x)) for i, (a, g, x) in enumerate(zip(p, truth, w or [1] * len(p), strict=True))], "k int, v int, p array<double>, g int, w double")
    return df, losses.class_rows(df, ["k"], F.col("p"), F.col("g"), F.col("w"), normal=softmax, voxel=["v"])


#: Own logits of seven voxels over three classes, their true classes and weights; class 2 has one voxel.
LOGITS = [[1.5, 0.2, -1.0], [0.1, 0.3, 0.2], [-2.0, 1.0, 0.5], [0.0, 0.0, 3.0], [0.7, -0.7, 0.0], [2.2, 1.1, -0.4], [0.5, 2.5, 1.0]]
TRUE, WEIGHTS = [0, 1, 1, 2, 0, 0, 1], [1.0, 2.0, 0.5, 1.0, 3.0, 1.0, 0.25]


def softmaxed(v):
    e = [math.exp(x) for x in v]
    return [x / sum(e) for x in e]


@pytest.mark.parametrize("weights", [None, WEIGHTS])
def test_segmentation_losses(spark, weights):
    """Every loss from its definition, class by class, in plain Python."""
    w = weights or [1.0] * 7
    p, g = [softmaxed(v) for v in LOGITS], TRUE
    df, rows = classes(spark, LOGITS, g, weights)
    entropy = [-math.log(q[k]) for q, k in zip(p, g, strict=True)]
    got = losses.cross_entropy(df, ["k"], F.col("p"), F.col("g"), F.col("w") if weights else None).first().cross_entropy
    assert got == pytest.approx(sum(x * y for x, y in zip(w, entropy, strict=True)) / sum(w))
    sums = losses.class_sums(rows, ["k"])
    family = losses.dice_family(sums, ["k"]).first()
    total = lambda f: [sum(w[i] * f(p[i][c], float(g[i] == c)) for i in range(7)) for c in range(3)]
    both, mine, squares, truth = total(lambda x, o: x * o), total(lambda x, o: x), total(lambda x, o: x * x), total(lambda x, o: o)
    mean = lambda v: sum(v) / len(v)
    e = losses.EPS
    assert family.dice == pytest.approx(1 - mean([(2 * x + e) / (y + z + e) for x, y, z in zip(both, squares, truth, strict=True)]))
    assert family.dice_ns == pytest.approx(1 - mean([(2 * x + e) / (y + z + e) for x, y, z in zip(both, mine, truth, strict=True)]))
    assert family.tversky == pytest.approx(1 - sum(both) / (sum(both) + 0.5 * (sum(mine) - sum(both)) + 0.5 * (sum(truth) - sum(both)) + e))
    plain = lambda f: [sum(f(p[i][c], float(g[i] == c)) for i in range(7)) for c in range(3)]
    missed, extra, n, count = plain(lambda x, o: (o - x) ** 2 * o), plain(lambda x, o: (o - x) ** 2 * (1 - o)), plain(lambda x, o: 1 - o), truth
    assert family.sens_spec == pytest.approx(sum(0.05 * a / (b + e) + 0.95 * c / (d + e) for a, b, c, d in zip(missed, count, extra, n, strict=True)))
    for kind, k in (("square", [1 / t**2 for t in truth]), ("simple", [1 / t for t in truth]), ("uniform", [1.0] * 3)):
        score = 2 * sum(a * b for a, b in zip(k, both, strict=True)) / sum(a * max(x + y, 1.0) for a, x, y in zip(k, mine, truth, strict=True))
        assert losses.generalised_dice(sums, ["k"], kind).first().gdsc == pytest.approx(1 - score), kind
    if not weights:
        plus = losses.dice_plus_xent(losses.dice_family(sums, ["k"]), losses.cross_entropy(df, ["k"], F.col("p"), F.col("g")), ["k"])
        assert plus.first().dice_plus_xent == pytest.approx(mean(entropy) - mean([(2 * x + e) / (y + z + e) for x, y, z in zip(both, mine, truth, strict=True)]))


def test_losses_of_certain_predictions(spark):
    """Right everywhere: no loss; wrong everywhere: all of it."""
    sure = lambda k: [60.0 * (c == k) for c in range(3)]
    truth = [2, 0, 1, 1, 2]
    right, wrong = (losses.dice_family(losses.class_sums(classes(spark, [sure(f(k)) for k in truth], truth)[1], ["k"]), ["k"]).first() for f in (lambda k: k, lambda k: (k + 1) % 3))
    assert (right.dice, right.dice_ns, right.sens_spec) == tuple(pytest.approx(0, abs=1e-4) for _ in range(3))
    assert (wrong.dice, wrong.dice_ns, wrong.tversky) == tuple(pytest.approx(1, abs=1e-4) for _ in range(3))


def test_one_hot(spark):
    got = [r[0] for r in spark.range(1, 5).select(intensity.one_hot(F.col("id"), 5, "int")).collect()]
    assert got == [[int(i == k) for i in range(5)] for k in range(1, 5)]


#: Own histories; what each rule does with them is worked out beside it.
STOPS = [
    ("mean", [5, 3, 4, 4.1], [5, 3, 4, 3.9]),  # the mean of the three before is 4
    ("robust_mean", [9, 2, 3, 4, -9, 3.2], [9, 2, 3, 4, -9, 2.8]),  # 9 and -9 lie outside: the mean is 3
    ("median", [7, 1, 2, 2.5], [7, 1, 2, 1.5]),  # the median is 2
    ("generalisation_loss", [4, 9, 5.1], [4, 9, 4.9]),  # (last - 4) / 5 against 0.2
    ("validation_up", [2**i for i in range(15)], [2**-i for i in range(15)]),  # all strips rise, or all fall
    ("median_smoothing", [3 * i for i in range(12)], [-3 * i for i in range(12)]),  # no gradient is under 0.03, or all are
]


@pytest.mark.parametrize(("mode", "stop", "go"), STOPS)
def test_early_stopping(spark, mode, stop, go):
    df = spark.createDataFrame([([float(x) for x in stop],), ([float(x) for x in go],)], "h array<double>")
    assert [r[0] for r in df.select(control.should_stop(F.col("h"), mode)).collect()] == [True, False]


def vox(spark, shape, value):
    cells = [(1, x, y, z, float(value(x, y, z))) for x in range(shape[0]) for y in range(shape[1]) for z in range(shape[2])]
    return spark.createDataFrame(cells, "k int, x int, y int, z int, value double")


def test_geometry(spark):
    v = vox(spark, (2, 2, 1), lambda x, y, z: 2 * x + y)
    flipped = {(r.x, r.y): r.value for r in volume.flip(v, (2, 2, 1), (0,)).collect()}
    assert flipped == {(0, 0): 2, (0, 1): 3, (1, 0): 0, (1, 1): 1}
    big = vox(spark, (2, 3, 4), lambda x, y, z: int((x, y, z) == (0, 0, 0)))
    assert [(r.x, r.y, r.z) for r in volume.flip(big, (2, 3, 4), (0, 1, 2)).where("value = 1").collect()] == [(1, 2, 3)]
    cube = vox(spark, (8, 8, 8), lambda x, y, z: 1)
    padded = volume.pad(cube, ["k"], (8, 8, 8), (3, 0, 0))
    assert padded.count() == 14 * 64
    assert volume.unpad(cube, (8, 8, 8), (3, 0, 0)).count() == 2 * 64
    assert volume.unpad(cube, (8, 8, 8), (9, 0, 0)).count() == 512
    g = volume.gradient(cube, ["k"], (8, 8, 8), 1)
    assert (g.count(), g.where("value <> 0").count()) == (6**3, 0)
    assert volume.smooth(cube, ["k"], 0.5).count() == 512
    assert volume.expand_shape([100, 1, 100]) == [100, 100, 1, 1, 1]


def test_weighted_and_balanced_centres(spark):
    shape, window = (8, 6, 5), (3, 2, 1)
    one = vox(spark, shape, lambda x, y, z: int((x, y, z) == (4, 3, 2)))
    got = windows.weighted_centres(one, ["k"], shape, window, 10)
    assert {(r.x, r.y, r.z) for r in got.collect()} == {(4, 3, 2)}
    assert got.count() == 10
    flat = windows.weighted_centres(vox(spark, shape, lambda *_: 0), ["k"], shape, window, 50).collect()
    assert len(flat) == 50
    assert all(1 <= r.x <= 6 and 1 <= r.y <= 5 and 0 <= r.z <= 4 for r in flat)
    hits = windows.balanced_centres(one, ["k"], shape, window, 500).where("x = 4 and y = 3 and z = 2").count()
    assert hits >= 200


def test_split(spark):
    ids = spark.range(4).withColumnRenamed("id", "subject_id")
    counts = lambda v, i, n=4: {r.phase: r["count"] for r in C.random_split(spark.range(n).withColumnRenamed("id", "subject_id"), "subject_id", v, i).groupBy("phase").count().collect()}
    assert counts(2.0, 2.0) == {"validation": 4}
    assert counts(0.2, 0.2) == {"training": 2, "validation": 1, "inference": 1}
    twice = spark.createDataFrame([(1, "training"), (1, "validation")], "subject_id long, phase string")
    assert C.with_partition(ids, twice).count() == 2


def test_global_rank_is_total(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("id"))
    ranked = C.global_rank(df, [F.col("id")])
    assert ranked.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()[0:3] == (20_000, 1, 20_000)
    assert ranked.join(ranked.select((F.col("rank") - 1).alias("rank"), F.col("id").alias("next")), "rank").where("next <= id").count() == 0


def test_edit_distance_and_hints(spark):
    pairs = [("abcd", "abdc", 1), ("", "abc", 3), ("abc", "", 3), ("kitten", "sitting", 3), ("same", "same", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    assert df.where(S.damerau_levenshtein(F.col("a"), F.col("b")) != F.col("d")).count() == 0
    assert all(spec.edit_distance(a, b) == d for a, b, d in pairs)
    with pytest.raises(ValueError, match="did you mean whitening"):
        spec.read_config("[NETWORK]\nwhitenin=True\n")
    config = spec.read_config("[T1]\npath_to_search=/a\npixdim=(1, 2, 3)\n[NETWORK]\ncutoff=(0.05,0.9)\n", {"NETWORK": {"batch_size": "7"}})
    assert (config.sources["T1"].pixdim, config.sections["NETWORK"].cutoff, config.sections["NETWORK"].batch_size) == ((1, 2, 3), (0.05, 0.9), 7)
