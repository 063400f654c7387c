"""Runs from a configuration, files to files; samplers, metrics and streams as plug-ins."""

import pytest
from pyspark.sql import functions as F

from arraymill.plans import evaluation as E
from arraymill.plans import runs as R
from arraymill.plans.spec import read_config
from arraymill.sources import images
from arraymill.streaming import pipeline

AT = "subject_id string, x int, y int, z int, value double"


def volume_rows(subject, value, shape=(3, 2, 2)):
    return [(subject, x, y, z, float(value(x, y, z))) for x in range(shape[0]) for y in range(shape[1]) for z in range(shape[2])]


def test_evaluation_from_files_to_files(spark, tmp_path):
    identity = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
    sides = {"guess": {"p1": lambda x, y, z: x < 2, "p2": lambda x, y, z: y == 0}, "truth": {"p1": lambda x, y, z: x < 1, "p2": lambda x, y, z: y == 0}}
    for side, subjects in sides.items():
        for name, f in subjects.items():
            cells = [v for *_, v in volume_rows(name, f)]
            (tmp_path / f"{name}_{side}.nii").write_bytes(images.encode_nifti([3, 2, 2], cells, identity, [1, 1, 1]))
    (tmp_path / "truth.csv").write_text("".join(f"{s},{tmp_path}/{s}_truth.nii\n" for s in ("p1", "p2")))
    spec = read_config(f"""[inferred]
path_to_search = {tmp_path}
filename_contains = _guess
[label]
csv_file = {tmp_path}/truth.csv
[EVALUATION]
evaluations = dice,jaccard
save_csv_dir = {tmp_path}/out
[SEGMENTATION]
evaluation_units = foreground,label
num_classes = 2""")
    paths = R.evaluate_files(spark, spec, "segmentation")
    assert sorted(p.rsplit("/", 1)[1] for p in paths) == ["eval_label.csv", "eval_subject_id.csv", "eval_subject_id_label.csv"]
    rows = spark.read.csv(f"{tmp_path}/out/eval_subject_id.csv", header=True, inferSchema=True)
    assert {r.subject_id: (r.dice, r.jaccard) for r in rows.collect()} == {"p1": (pytest.approx(2 * 4 / 12), pytest.approx(0.5)), "p2": (1.0, 1.0)}


def test_unknown_names_are_answered_and_components_have_no_distances(spark):
    vox = spark.createDataFrame(volume_rows("a", lambda x, y, z: 1), AT)
    with pytest.raises(ValueError, match="did you mean regression"):
        R.run_evaluation(read_config(""), "regresion", vox, vox)
    with pytest.raises(ValueError, match="did you mean rmse"):
        R.run_evaluation(read_config("[EVALUATION]\nevaluations = rmsee"), "regression", vox, vox)
    with pytest.raises(ValueError, match="no distances"):
        E.evaluate_segmentation(vox.withColumns({"inferred": F.lit(1), "reference": F.lit(1)}), "subject_id", ("dice", "average_distance"), "cc")
    with pytest.raises(ValueError, match="neither csv_file nor path_to_search"):
        R.load_source(spark, read_config("[inferred]\nloader = nibabel").sources["inferred"], "inferred")


def test_metrics_and_samplers_of_ones_own(spark):
    @R.METRICS.register("largest_gap")
    def largest_gap(vox, keys):
        return vox.groupBy(*keys).agg(F.max(F.abs(F.col("inferred") - F.col("reference"))).alias("largest_gap"))

    @R.SAMPLERS.register("corner")
    def corner(vox, sizes, key, window, samples, shape=None):
        return sizes.select(key, F.lit(0).alias("draw"), *[F.lit(0).alias(f"{a}0") for a in "xyz"], *[F.lit(w).alias(f"{a}1") for a, w in zip("xyz", window, strict=True)])

    a = spark.createDataFrame(volume_rows("a", lambda x, y, z: x) + volume_rows("b", lambda x, y, z: 1), AT)
    b = a.withColumn("value", F.lit(1.0))
    frame = R.run_evaluation(read_config("[EVALUATION]\nevaluations = mae, largest_gap"), "regression", a, b)["subject_id",]
    assert {r.subject_id: (r.mae, r.largest_gap) for r in frame.collect()} == {"a": (pytest.approx(2 / 3), 1.0), "b": (0.0, 0.0)}
    drawn = R.run_training_windows(read_config("[NETWORK]\nwindow_sampling = corner"), a, (2, 1, 1), (3, 2, 2))
    assert {(r.subject_id, r.x, r.value) for r in drawn.collect()} == {("a", 0, 0.0), ("a", 1, 1.0), ("b", 0, 1.0), ("b", 1, 1.0)}


@pytest.mark.parametrize("name", ["uniform", "weighted", "balanced", "grid", "resize"])
def test_every_sampler_draws_windows_inside(spark, name):
    vox = spark.createDataFrame([(i, x, y, z, float(x == 2)) for i in (1, 2) for x in range(5) for y in range(4) for z in range(3)], "subject_id int, x int, y int, z int, value double")
    spec = read_config(f"[NETWORK]\nwindow_sampling = {name}\n[TRAINING]\nsample_per_volume = 3")
    window = (5, 4, 3) if name == "resize" else (2, 2, 2)
    rows = R.run_training_windows(spec, vox, window, (5, 4, 3)).groupBy("subject_id", "draw").agg(F.count("*").alias("n"), F.max("x").alias("x")).collect()
    assert {r.subject_id for r in rows} == {1, 2}
    assert all(r.n == window[0] * window[1] * window[2] and r.x == window[0] - 1 for r in rows)
    assert len(rows) == {"grid": None, "resize": 2}.get(name, 6) or name == "grid"


def test_inference_whitens_pads_and_fills(spark):
    vox = spark.createDataFrame(volume_rows("a", lambda x, y, z: x + y, (4, 4, 4)), AT)
    spec = read_config("[NETWORK]\nwhitening = True\n[INFERENCE]\nspatial_window_size = 2,2,2\nfill_constant = 9")
    out = R.run_inference(spec, vox, lambda cut: cut.where("x0 < 2"), (4, 4, 4))  # windows that are not predicted leave the constant
    got = {(r.x, r.y, r.z): r.value for r in out.collect()}
    assert len(got) == 64
    assert {v for (x, *_), v in got.items() if x == 3} == {9.0}
    inside = [v for (x, *_), v in got.items() if x < 3]
    values = sorted(x + y for x in range(4) for y in range(4))
    mean = sum(values) / 16
    std = (sum((v - mean) ** 2 for v in values) / 16) ** 0.5
    assert min(inside) == pytest.approx((0 - mean) / std)


def test_a_step_that_says_false_ends_the_run_and_later_files_stay(spark, tmp_path):
    path, check = str(tmp_path / "in"), str(tmp_path / "c")
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(path)
    seen = []

    def step(batch, number):
        seen.append(sorted(r.id for r in batch.collect())[0])
        return len(seen) < 2

    run = pipeline.run(pipeline.source(spark, path, 1), step, check)
    assert run.awaitTermination(120)
    assert run.stopped.is_set()
    assert seen == [0, 10]
    more = []
    again = pipeline.run(pipeline.source(spark, path, 1), lambda batch, n: more.append(batch.count()), check)
    again.awaitTermination(120)
    assert more == [10, 10]  # what came after the stop, and only that


def test_an_error_in_a_step_is_raised(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(path)

    def step(batch, number):
        raise RuntimeError("step failed")

    with pytest.raises(Exception, match="step failed"):
        pipeline.run(pipeline.source(spark, path), step, str(tmp_path / "c")).awaitTermination(120)


def test_endless_iterations_run_until_they_are_stopped(spark, tmp_path):
    seen = []

    def step(batch, number):
        seen.extend(r.iteration for r in batch.where("phase = 'inference'").collect())
        return len(seen) < 3

    run = pipeline.run(pipeline.inference_steps(spark, 20), step, str(tmp_path / "c"), once=False)
    assert run.awaitTermination(120)
    assert sorted(seen) == list(range(1, len(seen) + 1))
