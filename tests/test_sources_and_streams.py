import gzip

import numpy as np
import pytest

from arraymill.operators import catalog as C
from arraymill.plans import evaluation as E
from arraymill.sources import files, images
from arraymill.streaming import pipeline


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three wards with four scans of two kinds each, and a note that no pattern of a scan fits."""
    path = tmp_path_factory.mktemp("scans")
    for ward in ("north", "south", "west"):
        for scan in range(4):
            for kind in ("pet", "ct"):
                (path / f"{ward}-{scan}-{kind}.nii.gz").write_bytes(b"x")
    (path / "readme.txt").write_bytes(b"x")
    return str(path)


def test_directory(spark, folder):
    ids = lambda df: sorted(r.subject_id for r in df.collect())
    assert len(ids(files.scan_directory(spark, folder))) == 25
    pet = files.scan_directory(spark, folder, ["-pet"])
    assert len(set(ids(pet))) == 12
    assert {r.name for r in pet.collect()} == {f"{w}-{i}-pet.nii.gz" for w in ("north", "south", "west") for i in range(4)}
    both = files.scan_directory(spark, folder, ["north", "ct"])  # all parts must be in a name
    assert {r.name for r in both.collect()} == {f"north-{i}-ct.nii.gz" for i in range(4)}
    assert ids(files.scan_directory(spark, folder, ["south", "pet"], remove="-pet|south-")) == ["0", "1", "2", "3"]
    assert files.scan_directory(spark, folder, [".nii.gz"], ["west", "-pet"]).count() == 8
    with pytest.raises(ValueError, match="no file"):
        files.scan_directory(spark, folder, ["east"])
    with pytest.raises(ValueError, match="not unique"):
        files.scan_directory(spark, folder, [".nii.gz"], remove="-pet|-ct")


def test_paths_are_taken_as_given_or_under_home():
    there = {"/home/me/scans", "/data/a", "b"}
    exists = there.__contains__
    assert files.resolve_paths("/data/a, scans ,b,/data/a", "/home/me/", exists) == ["/data/a", "/home/me/scans", "b"]
    with pytest.raises(FileNotFoundError):
        files.resolve_paths("/data/a,c", "/home/me", exists)


def test_csv_tables(spark, tmp_path):
    (tmp_path / "t1.csv").write_text("001, /a.nii\n002,/b.nii\n")
    assert [tuple(r) for r in files.read_section(spark, str(tmp_path / "t1.csv"), "T1").collect()] == [("001", "/a.nii"), ("002", "/b.nii")]
    (tmp_path / "p.csv").write_text("001,Training\n002,inference\n")
    assert {r.phase for r in files.read_partition(spark, str(tmp_path / "p.csv")).collect()} == {"training", "inference"}
    (tmp_path / "bad.csv").write_text("001,other\n")
    (tmp_path / "none.csv").write_text("")
    for name in ("bad", "none"):
        with pytest.raises(ValueError):
            files.read_partition(spark, str(tmp_path / f"{name}.csv"))


def test_alignment(spark):
    catalog = spark.createDataFrame([("a",), ("b",)], "subject_id string")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "subject_id string, v int")
    assert C.aligned(rows, catalog).count() == 2
    with pytest.raises(ValueError):
        C.aligned(rows.where("v = 1"), catalog)
    assert C.file_list(catalog, spark.createDataFrame([("a", "training")], "subject_id string, phase string"), "validation") is None
    with pytest.raises(ValueError):
        C.file_list(catalog, sections=["x"])


def test_nifti(spark, tmp_path):
    a = np.arange(24, dtype=np.float32)
    affine = [2, 0, 0, 5, 0, 3, 0, 6, 0, 0, 4, 7, 0, 0, 0, 1]
    raw = images.encode_nifti([2, 3, 4, 1, 1], a, affine, [2, 3, 4])
    (tmp_path / "a.nii").write_bytes(raw)
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(raw))
    rows = images.read_volumes(spark, str(tmp_path), "*.nii*").collect()
    assert len(rows) == 2
    for r in rows:
        assert (r.shape, r.pixdim, r.affine, r.voxels) == ([2, 3, 4], [2, 3, 4], affine, a.tolist())
    back = images.nifti_bytes(images.read_volumes(spark, str(tmp_path), "a.nii")).first()
    assert bytes(back.content) == raw
    (tmp_path / "c.txt").write_bytes(b"no image at all")
    with pytest.raises(Exception, match="no loader"):
        images.read_volumes(spark, str(tmp_path), "c.txt").collect()


def test_models_and_sinks(spark, tmp_path):
    (tmp_path / "m.txt").write_text("T1 0.0 50.5 100\n\nFLAIR 1 2 3\n")
    model = files.read_model(spark, str(tmp_path / "m.txt"))
    assert {r.key: r.landmarks for r in model.collect()} == {"T1": [0.0, 50.5, 100.0], "FLAIR": [1, 2, 3]}
    files.write_model(model, str(tmp_path / "versions"))
    files.write_model(model.where("key = 'T1'"), str(tmp_path / "versions"))
    assert files.latest_model(spark, str(tmp_path / "versions")).count() == 1
    names = files.write_metrics({("subject_id", "label"): spark.createDataFrame([("a", 1, 0.5)], "subject_id string, label int, dice double")}, str(tmp_path))
    assert names[0].endswith("eval_subject_id_label.csv")
    assert spark.read.csv(names[0], header=True).columns == ["subject_id", "label", "dice"]


def test_evaluation(spark):
    cells = [(s, x, y, z, int(x == 0), int(x == 0 and y < 2)) for s in ("foo", "bar") for x in range(3) for y in range(3) for z in range(3)]
    vox = spark.createDataFrame(cells, "subject string, x int, y int, z int, inferred int, reference int")
    out = E.evaluate_segmentation(vox, "subject")
    assert set(out["subject",].columns) == {"subject", "tp", "fp", "fn", "tn", "dice", "jaccard", "average_distance"}
    assert out["subject",].first().jaccard == pytest.approx(6 / 9)
    label = E.evaluate_segmentation(vox, "subject", ("dice",), "label", [0, 1])
    assert label["label",].count() == 2
    cc = E.evaluate_segmentation(vox, "subject", ("dice",), "cc")["subject", "cc_id"]
    assert [r.cc_id for r in cc.collect()] == ["r1_s1", "r1_s1"]
    with pytest.raises(ValueError, match="did you mean dice"):
        E.evaluate_segmentation(vox, "subject", ("dise",))


def test_stream(spark, tmp_path):
    seen = []
    path = str(tmp_path / "in")
    spark.range(100).repartition(4).write.parquet(path)
    query = pipeline.run(pipeline.source(spark, path, 1), lambda batch, n: seen.append(batch.count()), str(tmp_path / "c1"))
    query.awaitTermination(120)
    assert sum(seen) == 100
    assert len(seen) == 4


def test_affines_of_other_conventions():
    assert images.lps_to_ras([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 0, 0, 0, 1]) == [-1, -2, -3, -4, -5, -6, -7, -8, 9, 10, 11, 12, 0, 0, 0, 1]
    with pytest.raises(ImportError):
        images.decode(b"", "simpleitk")


def test_stream_stops(spark, tmp_path):
    rows = [("a", i, float(v)) for i, v in enumerate([1, 2, 1, 2, 1, 2, 1, 2, 3])] + [("b", i, 1.0) for i in range(3)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, i int, loss double").coalesce(1).write.parquet(path)
    out = pipeline.stop_signals(pipeline.source(spark, path), "k", "i", "loss", 9)
    query = out.writeStream.format("memory").queryName("stops").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.k, r.n, r.stop) for r in spark.table("stops").collect()} == {("a", 9, True), ("b", 3, None)}


def test_masks_of_empty_tables(spark):
    from arraymill.operators import surface

    none = spark.createDataFrame([], "k int, x int, y int, z int")
    assert surface.border(none, ["k"]).count() == 0
    assert surface.components(none, ["k"]).count() == 0
    assert surface.border_distances(none, none, ["k"]).count() == 0
    assert surface.surface_distances(none, none, ["k"]).count() == 0
    one = spark.createDataFrame([(1, 2, 2, 2)], "k int, x int, y int, z int")
    assert surface.surface_distances(one, none, ["k"]).count() == 0  # a side without voxels has no distance
    assert [tuple(r) for r in surface.filled(none, one, ["k"], (5, 5, 5)).collect()] == [(1, 2, 2, 2)]  # a hole that touches no face
