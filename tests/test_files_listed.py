"""Listed files are opened by the tasks: the driver lists no folder, and their voxels never count as a small table."""

from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from arraymill.plans import runs as R
from arraymill.plans.spec import read_config
from arraymill.sources import images

UNIT = [float(i % 5 == 0) for i in range(16)]


def run(spark, folder, n, listed):
    rows = [(f"s {i}.nii", [3, 2, 2], UNIT, [1.0] * 3, [float(i + v) for v in range(12)]) for i in range(n)]
    packed = spark.createDataFrame(rows, images.PACKED)
    written = images.write_files(images.nifti_bytes(packed), f"{folder}/in")
    assert {(r.name, r.path) for r in written.collect()} == {(f"s {i}.nii", f"file:{folder}/in/s {i}.nii") for i in range(n)}
    (folder / "list.csv").write_text("".join(f"{k},{folder}/in/s {i}.nii\n" for k, i in listed))
    return read_config(f"[image]\ncsv_file = {folder}/list.csv\n[INFERENCE]\nspatial_window_size = 3,3,3\noutput_postfix = _made\nsave_seg_dir = {folder}/out")


def test_no_folder_is_listed_by_the_driver(spark, tmp_path, monkeypatch):
    load, formats = DataFrameReader.load, []

    def watched(self, path=None, format=None, schema=None, **options):  # noqa: A002
        formats.append(path)
        return load(self, path, format, schema, **options)

    monkeypatch.setattr(DataFrameReader, "load", watched)
    spec = run(spark, tmp_path, 9, [(i, i) for i in range(9)])
    out = R.infer_files(spark, spec, lambda cut: cut.withColumn("value", 3 * F.col("value")))
    assert formats == []
    assert {r.subject_id: r.path for r in out.collect()} == {str(i): f"file:{tmp_path}/out/{i}_made.nii" for i in range(9)}
    assert all(images.decode_nifti((tmp_path / "out" / f"{i}_made.nii").read_bytes())["voxels"].tolist() == [3.0 * (i + v) for v in range(12)] for i in range(9))


def test_a_file_of_several_subjects_is_a_row_of_each(spark, tmp_path):
    spec = run(spark, tmp_path, 3, [("a", 0), ("b", 0), ("c", 2), ("b", 0)])
    got = R.load_packed(spark, spec.sources["image"], "image")
    assert got.columns == ["path", "shape", "affine", "pixdim", "voxels", "subject_id"]
    assert sorted((r.subject_id, r.voxels[0]) for r in got.collect()) == [("a", 0.0), ("b", 0.0), ("b", 0.0), ("c", 2.0)]


def test_listed_volumes_are_no_small_table(spark, tmp_path):
    spec = run(spark, tmp_path, 2, [(0, 0), (1, 1)])
    vox = R.load_source(spark, spec.sources["image"], "image")
    assert vox._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 2**40


def test_folders_that_pyarrow_does_not_reach_go_to_sparks_reader(spark, tmp_path):
    assert images.reached("file:/a b/c") and images.reached("/a") and not images.reached("viewfs://store/in")
    spec = run(spark, tmp_path, 3, [(0, 0), (1, 1)])
    want = sorted((r.subject_id, r.path, r.voxels) for r in R.load_packed(spark, spec.sources["image"], "image").collect())
    reached, images.reached = images.reached, lambda path: False
    try:
        got = R.load_packed(spark, spec.sources["image"], "image").select("subject_id", "path", "voxels").collect()
    finally:
        images.reached = reached
    assert sorted(map(tuple, got)) == want and len(want) == 2
