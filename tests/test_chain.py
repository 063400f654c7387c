"""The chain of a run: reading at axes and voxel sizes, normalisation, augmentation, on volumes of their own shapes."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraymill.operators import splines as Z
from arraymill.operators import volume as V
from arraymill.plans import chain
from arraymill.plans import runs as R
from arraymill.plans.spec import read_config

from .test_bricks import brute
from .test_own_shapes import arrays

SHAPES = {"a": (3, 4, 2), "b": (5, 2, 3)}


def packed(spark, affines, pixdims, shapes=SHAPES):
    rng = np.random.default_rng(2)
    a = {k: rng.normal(size=s) for k, s in shapes.items()}
    rows = [(k, list(v.shape), np.ravel(affines[k]).tolist(), list(pixdims[k]), v.reshape(-1).tolist()) for k, v in a.items()]
    return a, spark.createDataFrame(rows, "subject_id string, shape array<int>, affine array<double>, pixdim array<double>, voxels array<double>")


def draw(key, name, seed):
    return zlib.crc32(f"{key}:{name}:{seed}".encode()) / 2**32


def affine(columns):
    out = np.eye(4)
    out[:3, :3] = np.array(columns, float).T
    return out


PLAIN = {"affines": {k: np.eye(4) for k in SHAPES}, "pixdims": {k: (1.0, 1.0, 1.0) for k in SHAPES}}


def test_axes_are_turned_by_each_volumes_own_affine(spark):
    affines = {"a": affine([(0, -2, 0.1), (0, 0, 3), (1, 0, 0)]), "b": affine([(-1, 0, 0), (0, 1, 0), (0, 0, -1)])}
    a, df = packed(spark, affines, {"a": (2.0, 3.0, 1.0), "b": (1.0, 1.0, 1.0)})
    source = read_config("[image]\npath_to_search = /x\naxcodes = L, A, S").sources["image"]
    vox, volumes = chain.as_read(R.voxel_table(df, "subject_id"), R.volumes_of(df, "subject_id"), source, "subject_id")
    got = arrays(vox)
    assert np.allclose(got["a", 0, 0], a["a"].transpose(2, 0, 1)[::-1, ::-1])  # axis 2 is R, axis 0 is P, axis 1 is S
    assert np.allclose(got["b", 0, 0], a["b"][:, :, ::-1])
    assert {r.subject_id: (r.nx, r.ny, r.nz, list(r.pixdim)) for r in volumes.collect()} == {"a": (2, 3, 4, [1.0, 2.0, 3.0]), "b": (5, 2, 3, [1.0, 1.0, 1.0])}


def test_turning_and_resampling_are_one_sampling(spark):
    affines = {"a": affine([(0, -2, 0), (0, 0, 1), (1, 0, 0)]), "b": np.eye(4)}
    a, df = packed(spark, affines, {"a": (2.0, 1.0, 1.0), "b": (1.0, 1.5, 2.0)})
    source = read_config("[image]\npath_to_search = /x\naxcodes = R, A, S\npixdim = 0.5").sources["image"]
    vox, volumes = chain.as_read(R.voxel_table(df, "subject_id"), R.volumes_of(df, "subject_id"), source, "subject_id")
    got = arrays(vox)

    def zoomed(v, to):
        for i, t in enumerate(to):
            at = np.linspace(0, v.shape[i] - 1, t)
            v = np.apply_along_axis(lambda line, at=at: np.interp(at, np.arange(len(line)), line), i, v)
        return v

    assert np.allclose(got["a", 0, 0], zoomed(a["a"].transpose(2, 0, 1)[:, ::-1], (4, 12, 8)))
    assert np.allclose(got["b", 0, 0], zoomed(a["b"], (10, 6, 12)))
    assert all(list(r.pixdim) == [0.5] * 3 for r in volumes.collect())


def test_cubic_sampling_is_the_spline_through_the_voxels(spark):
    _, df = packed(spark, **PLAIN)
    vox = R.voxel_table(df, "subject_id")
    keys, shape = V.sized(["subject_id", "t", "m"])
    want = {(r.subject_id, r.x, r.y, r.z): r.value for r in Z.zoom_cubic(vox, keys, shape, tuple(n + 2 for n in shape)).collect()}
    source = [(n - 1) / (n + 1) for n in shape]
    got = chain.sampled(vox, R.volumes_of(df, "subject_id"), "subject_id", [[source[i] if i == j else 0.0 for j in range(3)] + [0.0] for i in range(3)], [n + 2 for n in shape], 3)
    rows = {(r.subject_id, r.x, r.y, r.z): r.value for r in got.collect()}
    assert rows.keys() == want.keys() and all(rows[p] == pytest.approx(v, abs=1e-9) for p, v in want.items())


@pytest.mark.parametrize("order", [0, 1])
def test_volumes_of_several_bricks_are_sampled_by_their_own_sizes(spark, order):
    shapes = {"a": (19, 3, 9), "b": (2, 10, 17)}
    a, df = packed(spark, {k: np.eye(4) for k in shapes}, {k: (1.0,) * 3 for k in shapes}, shapes)
    nx, ny, nz = (F.col(n) for n in V.SIZES)
    matrix = [[0.5, 0.0, 0.0, 0.25], [0.0, -1.0, 0.0, (ny - 1).cast("double")], [0.0, 0.0, 1.0, 0.75]]
    got = arrays(chain.sampled(R.voxel_table(df, "subject_id"), R.volumes_of(df, "subject_id"), "subject_id", matrix, [2 * nx, ny, nz], order))
    for k, v in a.items():
        assert got[k, 0, 0].shape == (2 * v.shape[0], *v.shape[1:])
        cells = {p: float(v[p]) for p in np.ndindex(v.shape)}
        for p in np.ndindex(got[k, 0, 0].shape):
            at = (0.5 * p[0] + 0.25, v.shape[1] - 1 - p[1], p[2] + 0.75)
            want = brute(cells, v.shape, at) if order else cells[tuple(min(round(q), n - 1) for q, n in zip(at, v.shape, strict=True))]
            assert got[k, 0, 0][p] == pytest.approx(want, abs=1e-9)


def test_shrinking_volumes_are_smoothed_by_their_own_width(spark):
    shapes = {"a": (6, 5, 7), "b": (5, 6, 4), "c": (4, 4, 4), "d": (5, 5, 5)}
    _, df = packed(spark, {k: np.eye(4) for k in shapes}, {k: (1.0,) * 3 for k in shapes}, shapes)
    vox = R.voxel_table(df, "subject_id")
    spec = read_config("[image]\npath_to_search = /x\n[TRAINING]\nscaling_percentage = -60, 10\nantialiasing = True")
    got = arrays(chain.augmented(spec, vox, "subject_id", 3))
    for k, s in shapes.items():
        by = tuple((-60 + 70 * draw(k, f"scale{i}", 3) + 100) / 100 for i in range(3))
        alone = vox.where(F.col("subject_id") == k).drop("nx", "ny", "nz")
        want = V.rescaled(alone, ["subject_id", "t", "m"], s, by).collect()
        assert got[k, 0, 0].size == len(want)
        assert all(got[k, 0, 0][r.x, r.y, r.z] == pytest.approx(r.value) for r in want)
    assert any(all(-60 + 70 * draw(k, f"scale{i}", 3) < 0 for i in range(3)) for k in shapes)


def test_composed_matrix_is_flip_then_rotation(spark):
    a, df = packed(spark, **PLAIN)
    spec = read_config("[image]\npath_to_search = /x\n[TRAINING]\nrandom_flipping_axes = 0,1,2\nrotation_angle_x = -90, 90\nrotation_angle_z = 30, 30")
    got = arrays(chain.augmented(spec, R.voxel_table(df, "subject_id"), "subject_id", 5))
    for k, v in a.items():
        for i in range(3):
            if draw(k, f"flip{i}", 5) < 0.5:
                v = np.flip(v, i)
        rows = [(k, *p, float(v[p])) for p in np.ndindex(v.shape)]
        alone = spark.createDataFrame(rows, "subject_id string, x int, y int, z int, value double")
        turn = V.rotation((-90 + 180 * draw(k, "angle0", 5), 0.0, 30.0), v.shape)
        want = {(r.x, r.y, r.z): r.value for r in V.warped(alone, ["subject_id"], v.shape, turn, 1, "replicate").collect()}
        assert all(got[k, 0, 0][p] == pytest.approx(want[p]) for p in np.ndindex(v.shape))


def test_reference_file_whitening_bias_and_deformation(spark, tmp_path):
    a, df = packed(spark, **PLAIN)
    (tmp_path / "model.txt").write_text("0_0 " + " ".join(str(i * i) for i in range(13)))
    spec = read_config(f"[image]\npath_to_search = /x\n[NETWORK]\nnormalisation = True\nnorm_type = median\nhistogram_ref_file = {tmp_path}/model.txt")
    got = arrays(R.run_chain(spec, df, "image"))
    for k, v in a.items():
        p = np.quantile(v, (0.01, 0.5, 0.99))
        want = np.where(v < p[1], 36 * (v - p[0]) / (p[1] - p[0]), 36 + (144 - 36) * (v - p[1]) / (p[2] - p[1]))
        assert np.allclose(got[k, 0, 0], want)
    white = arrays(R.run_chain(read_config("[image]\npath_to_search = /x\n[NETWORK]\nwhitening = True"), df, "image"))
    assert all(abs(v.mean()) < 1e-9 and v.std() == pytest.approx(1) for v in white.values())
    more = read_config("[image]\npath_to_search = /x\n[TRAINING]\nbias_field_range = 0.5, 0.5\nbf_order = 1\ndo_elastic_deformation = True\nproportion_to_deform = 0.0")
    for (k, *_), v in arrays(R.run_chain(more, df, "image", seed=1)).items():
        at = np.stack([i / max(1, n - 1) for i, n in zip(np.indices(v.shape), v.shape, strict=True)])
        assert np.allclose(v, a[k] * np.exp(0.5 * (1 + at.sum(axis=0))))
    all_moved = read_config("[image]\npath_to_search = /x\n[TRAINING]\ndo_elastic_deformation = True\nproportion_to_deform = 1.0\ndeformation_sigma = 0.8")
    moved = arrays(R.run_chain(all_moved, df, "image", seed=1))
    assert all(moved[k, 0, 0].shape == v.shape and np.abs(moved[k, 0, 0] - v).max() > 0.05 and moved[k, 0, 0].max() <= v.max() + 1e-9 for k, v in a.items())


def test_keys_without_meaning_are_refused(spark):
    with pytest.raises(ValueError, match="rgb_normalisation, volume_padding_to_size"):
        R.run_chain(read_config("[image]\npath_to_search = /x\n[NETWORK]\nrgb_normalisation = True\nvolume_padding_to_size = 10"), None, "image")
    assert math.isclose(draw("a", "x", 1), spark.createDataFrame([("a",)], "k string").select(chain.uniform("k", "x", 1)).first()[0])
