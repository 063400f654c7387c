"""Rules of runs, windows and shapes: fixed cases, and columns against the functions on plain values."""

import pytest
from pyspark.sql import functions as F

from arraymill.operators import catalog as C
from arraymill.operators import control as T
from arraymill.operators import volume as V
from arraymill.operators import windows as W
from arraymill.plans.spec import read_config
from arraymill.streaming import pipeline as S


def test_phases():
    cases = {("train", None, False): "training", ("train", None, True): "training,validation", ("infer", None, False): "inference", ("evaluate", None, True): "inference", ("train", "all", True): "all"}
    assert {k: ",".join(C.phases_for(*k)) for k in cases} == cases


def test_columns_follow_the_rules_of_values(spark):
    rows = [(a, p, v) for a in ("train", "inference", "evaluation") for p in (None, "", "all") for v in (True, False)]
    df = spark.createDataFrame(rows, "a string, p string, v boolean").withColumn("got", C.phases_column(F.col("a"), F.col("p"), F.col("v")))
    assert all(r.got == C.phases_for(r.a, r.p, r.v) for r in df.collect())
    runs = spark.createDataFrame([(1, 3, 40, 10, 3), (2, 0, 5, 0, 2), (3, 5, 5, 1, 1), (4, -2, 4, 2, 1)], "run int, f int, l int, e int, v int")
    got = T.schedules(runs, ["run"], *[F.col(c) for c in "flev"]).collect()
    for k, f, last, e, v in runs.collect():
        want = {tuple(r) for r in T.iterations(spark, f, last, e, v).collect()}
        assert {(r.iteration, r.phase, r[2]) for r in got if r[0] == k} == want


def test_windows_and_centres():
    assert W.window_sizes([8, 0, -1], [128, 64, 32]) == W.window_sizes([8], [128, 64, 32]) == [8, 64, 32]
    assert W.largest_window([[8, 12, 4], [10, 2, 32]]) == [10, 12, 32]
    centres = [W.transform_centre(p, (20, 30, 24), "RAS", "LSP", (1.0, 2.0, 1.5), (0.5, 1.5, 2.0)) for p in ((17, 24, 6), (10, 30, 2), (1, 8, 11))]
    assert centres == [[6, 6, 6], [20, 2, 0], [38, 11, 22]]


def test_shapes_and_affines(spark):
    shapes = {(5, 7): (5, 7, 1, 1, 1), (5, 7, 9): (5, 7, 9, 1, 1), (5, 1, 9): (5, 9, 1, 1, 1), (5, 7, 9, 4): (5, 7, 9, 4, 1), (5, 7, 9, 4, 3): (5, 7, 9, 4, 3), (5, 7, 9, 4, 1, 3): (5, 7, 9, 4, 3)}
    rows = spark.createDataFrame([(list(s),) for s in shapes], "s array<int>").withColumn("e", V.expanded_shape(F.col("s"))).collect()
    assert {tuple(r.s): tuple(r.e) for r in rows} == shapes == {s: tuple(V.expand_shape(list(s))) for s in shapes}
    affine = [[0, -2, 0, 7], [5, 0, 0, 8], [0, 0, 1, 9]]
    want = [[0, -4.5, 0, 7], [3, 0, 0, 8], [0, 0, 6, 9]]
    assert V.affine_with_pixdim(affine, (3.0, 4.5, 6.0)) == want
    flat = [float(v) for row in [*affine, [0, 0, 0, 1]] for v in row]
    got = spark.createDataFrame([(flat, [3.0, 4.5, 6.0])], "a array<double>, p array<double>").select(V.affine_column(F.col("a"), F.col("p"))).first()[0]
    assert got == pytest.approx([float(v) for row in [*want, [0, 0, 0, 1]] for v in row])


def test_sections_that_are_searched():
    spec = read_config("[searched]\npath_to_search = /a\n[listed]\npath_to_search = /a\ncsv_file = b.csv\n[features]\npath_to_search = /a\ncsv_data_file = c.csv\n[nothing]\nloader = nibabel")
    assert {n: s.searched for n, s in spec.sources.items()} == {"searched": True, "listed": False, "features": False, "nothing": False}


def test_a_sink_that_fails_after_a_stop_is_an_error(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(2).coalesce(1).write.parquet(path)
    held = []

    def step(batch, number):
        while not held:
            pass
        held[0].stopped.set()
        raise RuntimeError("the sink failed")

    held.append(S.run(S.source(spark, path, 1), step, str(tmp_path / "c")))
    with pytest.raises(Exception, match="the sink failed"):
        held[0].awaitTermination(120)


def test_batches_that_are_repeated_are_in_the_sink_once(spark, tmp_path):
    sink = S.keyed_sink(str(tmp_path / "out"))
    sink(spark.range(5), 0)
    sink(spark.range(3), 1)
    sink(spark.range(5), 0)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 0, 1, 1, 2, 2, 3, 4]
