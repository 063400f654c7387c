"""A run from files to files opens and decodes each of its files once."""

import os

from pyspark.sql import functions as F

from arraymill.plans import runs as R
from arraymill.plans.spec import read_config
from arraymill.sources import images


def test_infer_files_decodes_each_file_once(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.touch()
    path = str(calls)

    def counting(raw):
        with open(path, "a") as f:
            f.write("x\n")
        return images.decode_nifti(raw)

    monkeypatch.setitem(images.LOADERS, "counting", counting)
    os.makedirs(tmp_path / "in")
    for i in range(3):
        voxels = [float(v + i) for v in range(27)]
        (tmp_path / "in" / f"{i}.nii").write_bytes(images.encode_nifti([3, 3, 3], voxels, [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], [1.0] * 3))
    (tmp_path / "list.csv").write_text("".join(f"{i},{tmp_path}/in/{i}.nii\n" for i in range(3)))
    spec = read_config(f"[image]\ncsv_file = {tmp_path}/list.csv\nloader = counting\n[NETWORK]\nvolume_padding_size = 1,1,1\nvolume_padding_mode = edge\n[INFERENCE]\nspatial_window_size = 3,3,3\nborder = 1,1,1\nsave_seg_dir = {tmp_path}/out")
    R.infer_files(spark, spec, lambda cut: cut.withColumn("value", 2 * F.col("value")))
    assert len(calls.read_text().split()) == 3
    got = images.decode_nifti(next((tmp_path / "out").glob("2*.nii")).read_bytes())
    assert got["voxels"].tolist() == [2.0 * (v + 2) for v in range(27)]
