"""Files in several folders and of any rank, and volumes that carry their own shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraymill.operators import volume as V
from arraymill.plans import runs as R
from arraymill.plans.spec import read_config
from arraymill.sources import images

IDENTITY = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]


def write(path, a):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(images.encode_nifti(list(a.shape), np.ascontiguousarray(a, np.float32).reshape(-1), IDENTITY, [1, 1, 1]))


def source(text):
    return read_config(f"[image]\n{text}").sources["image"]


def arrays(vox, key="subject_id"):
    """{(key, t, m): array} of a view with sizes."""
    out = {}
    for r in vox.collect():
        out.setdefault((r[key], r.t, r.m), np.full((r.nx, r.ny, r.nz), np.nan))[r.x, r.y, r.z] = r.value
    return out


def test_listed_files_of_equal_names_in_two_folders(spark, tmp_path):
    a, b = np.arange(8.0).reshape(2, 2, 2), np.arange(12.0).reshape(3, 2, 2)
    write(tmp_path / "one" / "scan.nii", a)
    write(tmp_path / "two words" / "scan.nii", b)
    write(tmp_path / "one" / "other.nii", b)
    (tmp_path / "list.csv").write_text(f"p1,{tmp_path}/one/scan.nii\np2,file://{tmp_path}/two words/scan.nii\n")
    got = arrays(R.load_source(spark, source(f"csv_file = {tmp_path}/list.csv"), "image"))
    assert {k: v.tolist() for k, v in got.items()} == {("p1", 0, 0): a.tolist(), ("p2", 0, 0): b.tolist()}
    both = R.load_source(spark, source(f"path_to_search = {tmp_path}/two words, {tmp_path}/one\nfilename_contains = o\nfilename_not_contains = scan"), "image")
    assert list(arrays(both).values())[0].tolist() == b.tolist()


def test_a_listed_file_that_is_absent_is_an_error(spark, tmp_path):
    write(tmp_path / "one" / "scan.nii", np.zeros((2, 2, 2)))
    (tmp_path / "list.csv").write_text(f"p1,{tmp_path}/one/scan.nii\np2,{tmp_path}/one/gone.nii\n")
    with pytest.raises(FileNotFoundError, match="gone.nii"):
        R.load_source(spark, source(f"csv_file = {tmp_path}/list.csv"), "image")


@pytest.mark.parametrize("shape", [(3, 4), (1, 3, 4), (2, 3, 4), (2, 3, 2, 3), (2, 1, 3, 2, 2), (2, 3, 2, 2, 1, 3)])
def test_every_rank_has_its_five_axes(spark, shape):
    a = np.random.default_rng(3).normal(size=shape).astype(np.float32)
    packed = spark.createDataFrame([("p", list(shape), a.reshape(-1).tolist())], "subject_id string, shape array<int>, voxels array<float>")
    x, y, z, t, m = V.expand_shape(list(shape))
    want = a.reshape(x, y, z, t, m)
    vox = R.voxel_table(packed, "subject_id")
    got = arrays(vox)
    assert set(got) == {("p", i, j) for i in range(t) for j in range(m)}
    assert all(np.array_equal(got["p", i, j], want[..., i, j]) for i in range(t) for j in range(m))
    back = R.packed_volumes(vox, "subject_id").first()
    assert (back["shape"], back["voxels"]) == ([x, y, z, t, m], pytest.approx(a.reshape(-1).tolist()))
    if t * m > 1:
        with pytest.raises(Exception, match="several time points"):
            R.voxels_of(packed, "subject_id").collect()


@pytest.mark.parametrize("shape", [(4,), (2, 2, 2, 2, 2, 2)])
def test_other_shapes_are_errors(spark, shape):
    packed = spark.createDataFrame([("p", list(shape), [0.0] * int(np.prod(shape)))], "subject_id string, shape array<int>, voxels array<float>")
    with pytest.raises(Exception, match="no volume of shape"):
        R.voxel_table(packed, "subject_id").collect()


SHAPES = {1: (3, 2, 4), 2: (1, 5, 2), 3: (4, 4, 4)}


@pytest.fixture(scope="module")
def volumes(spark):
    rng = np.random.default_rng(1)
    a = {k: rng.normal(size=s) for k, s in SHAPES.items()}
    rows = [(k, 0, 0, *v.shape, *p, float(v[p])) for k, v in a.items() for p in np.ndindex(v.shape)]
    return a, spark.createDataFrame(rows, "k int, t int, m int, nx int, ny int, nz int, x int, y int, z int, value double")


@pytest.mark.parametrize("mode", ["constant", "edge", "wrap", "symmetric", "reflect", "minimum", "maximum", "mean"])
def test_padding_and_unpadding(volumes, mode):
    a, vox = volumes
    keys, shape = V.sized(["k", "t", "m"])
    grown = V.resized(V.pad(vox, keys, shape, (1, 2, 0), mode, after=(2, 1, 1)), (3, 3, 1))
    got = arrays(grown, "k")
    for k, v in a.items():
        width = ((1, 2), (2, 1), (0, 1))
        # axis after axis, as a border of one axis shows what earlier axes got
        for i, w in enumerate(width):
            v = np.pad(v, [w if i == j else (0, 0) for j in range(3)], mode)
        assert np.allclose(got[k, 0, 0], v)
    cut = V.unpad(grown, tuple(F.col(n) for n in V.SIZES), (1, 2, 0)).where("k = 3").collect()
    assert len(cut) == 5 * 3 * 5


def test_geometry_with_own_shapes_equals_that_of_each_alone(volumes):
    """Flips, turns, zooms, rotations, bias fields and pooling-free resampling: all volumes at once, and each by itself."""
    _, vox = volumes
    keys, shape = V.sized(["k", "t", "m"])
    steps = {
        "reorient": lambda v, ks, s: V.reorient(v, s, "RAS", "LPS"),
        "zoom": lambda v, ks, s: V.zoom(v, ks, s, tuple(2 * n + 1 for n in s), 1),
        "nearest": lambda v, ks, s: V.zoom(v, ks, s, tuple(n + 2 for n in s), 0),
        "rotation": lambda v, ks, s: V.warped(v, ks, s, V.rotation((20.0, -35.0, 50.0), s), 1, "symmetric"),
        "bias": lambda v, ks, s: V.bias_field(v, s, {(1, 0, 0): 0.3, (0, 1, 1): -0.2}),
    }
    for name, step in steps.items():
        got = {(r.k, r.x, r.y, r.z): r.value for r in step(vox, keys, shape).collect()}
        want = {(r.k, r.x, r.y, r.z): r.value for k, s in SHAPES.items() for r in step(vox.where(f"k = {k}").drop(*V.SIZES), ["k", "t", "m"], s).collect()}
        assert got.keys() == want.keys(), name
        assert all(abs(got[p] - want[p]) < 1e-9 for p in want), name


def test_training_windows_and_inference_of_own_shapes(spark):
    shapes = {"a": (4, 5, 3), "b": (6, 3, 3)}
    rows = [(k, t, 0, *s, *p, float(100 * t + sum(p))) for k, s in shapes.items() for t in (0, 1) for p in np.ndindex(s)]
    vox = spark.createDataFrame(rows, "subject_id string, t int, m int, nx int, ny int, nz int, x int, y int, z int, value double")
    spec = read_config("[NETWORK]\nwindow_sampling = grid\nvolume_padding_size = 1,0,0\nvolume_padding_mode = edge\n[INFERENCE]\nspatial_window_size = 3,3,3")
    cut = R.run_training_windows(spec, vox, (3, 3, 3)).groupBy("subject_id", "t", "draw").agg(F.count("*").alias("n")).collect()
    assert {r.subject_id for r in cut} == {"a", "b"} and {r.t for r in cut} == {0, 1} and all(r.n == 27 for r in cut)
    # a model that keeps the first time point only
    out = arrays(R.run_inference(spec, vox, lambda w: w.where("t = 0").withColumn("value", F.col("value") * 2)))
    assert set(out) == {("a", 0, 0), ("b", 0, 0)}
    assert all(out[k, 0, 0].shape == s and np.array_equal(out[k, 0, 0], 2 * np.indices(s).sum(axis=0)) for k, s in shapes.items())
    with pytest.raises(ValueError, match="three positive numbers"):
        R.run_inference(read_config("[INFERENCE]\nspatial_window_size = 3,0,3"), vox, lambda w: w)


def test_sides_of_different_shapes_are_not_compared(spark):
    side = lambda s: spark.createDataFrame([("a", 0, 0, *s, *p, 1.0) for p in np.ndindex(s)], "subject_id string, t int, m int, nx int, ny int, nz int, x int, y int, z int, value double")
    assert R.aligned_voxels(side((2, 2, 2)), side((2, 2, 2)), "subject_id").count() == 8
    with pytest.raises(Exception, match="shapes differ: a"):
        R.aligned_voxels(side((2, 2, 2)), side((2, 2, 3)), "subject_id").collect()
