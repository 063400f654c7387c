"""Sub-analyses that metrics share, and centre generators."""

import pytest
from pyspark.sql import functions as F

from arraymill.plans import runs as R
from arraymill.plans.spec import read_config

AT = "subject_id string, x int, y int, z int, value double"


def rows(subject, shape, value):
    return [(subject, x, y, z, float(value(x, y, z))) for x in range(shape[0]) for y in range(shape[1]) for z in range(shape[2])]


def test_an_analysis_is_made_once_for_all_metrics(spark):
    made = []

    @R.ANALYSES.register("positives")
    def positives(vox, keys):
        made.append("positives")
        return vox.where("reference > 0").groupBy(*keys).agg(F.count("*").alias("n"))

    @R.ANALYSES.register("doubled")
    @R.needs("positives")
    def doubled(vox, keys, positives):
        made.append("doubled")
        return positives.withColumn("n", 2 * F.col("n"))

    for i in range(3):
        @R.METRICS.register(f"count_{i}")
        @R.needs("positives", "doubled")
        def count(vox, keys, positives, doubled, i=i):
            return positives.join(doubled.withColumnRenamed("n", "m"), keys).select(*keys, (F.col("n") * i + F.col("m")).alias(f"count_{i}"))

    a = spark.createDataFrame(rows("a", (3, 2, 2), lambda x, y, z: x > 0), AT)
    spec = read_config("[EVALUATION]\nevaluations = dice, count_0, count_1, count_2\n[SEGMENTATION]\nevaluation_units = foreground")
    got = R.run_evaluation(spec, "segmentation", a, a)["subject_id",].first()
    assert (got.dice, got.count_0, got.count_1, got.count_2) == (1.0, 16, 24, 32)
    assert made == ["positives", "doubled"]


def test_unknown_analyses_are_answered(spark):
    @R.METRICS.register("odd")
    @R.needs("border_distance")
    def odd(vox, keys, **_):
        return vox

    a = spark.createDataFrame(rows("a", (2, 2, 2), lambda x, y, z: 1), AT)
    with pytest.raises(ValueError, match="did you mean border_distances"):
        R.run_evaluation(read_config("[EVALUATION]\nevaluations = odd"), "regression", a, a)


def test_generated_centres_are_moved_inside_and_padded(spark):
    @R.CENTRES.register("corners")
    def corners(vox, images, key, window, samples):
        return images.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("draw"), *[F.lit(p).alias(a) for a in "xyz"]) for i, p in enumerate((-5, 1, 99))])).alias("c")).select(key, "c.*")

    value = lambda x, y, z: 1 + 100 * x + 10 * y + z
    shapes = {"a": (5, 2, 3), "b": (3, 4, 3)}
    vox = spark.createDataFrame([(k, t, 0, *s, *r[1:4], r[4] + 1000 * t) for k, s in shapes.items() for t in (0, 1) for r in rows(k, s, value)], "subject_id string, t int, m int, nx int, ny int, nz int, x int, y int, z int, value double")
    got = {}
    for r in R.run_training_windows(read_config("[NETWORK]\nwindow_sampling = corners"), vox, (3, 3, 1)).collect():
        got.setdefault((r.subject_id, r.t, r.draw), {})[r.x, r.y, r.z] = r.value
    assert set(got) == {(k, t, i) for k in shapes for t in (0, 1) for i in range(3)}
    assert all(len(cells) == 9 for cells in got.values())
    for (k, t, i), cells in got.items():
        nx, ny, nz = shapes[k]
        centre = [min(max(p, 0), n - 1) for p, n in zip(((-5, 1, 99)[i],) * 3, (nx, ny, nz), strict=True)]
        x0, y0, z0 = (max(0, min(c - w // 2, n - w)) for c, w, n in zip(centre, (3, 3, 1), (nx, ny, nz), strict=True))
        for (x, y, z), v in cells.items():
            inside = y0 + y < ny
            assert v == (value(x0 + x, y0 + y, z0 + z) + 1000 * t if inside else 0.0)
