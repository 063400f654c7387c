"""Image files as packed volumes: NIfTI-1, and formats of Spark's image source (SC6-SC13, SC17, SK3, U3).

A folder is read by Spark's readers, so any store works; the driver holds its list of files. Files that are listed by path
are opened by the tasks, where pyarrow reaches their store, and no list of them goes through the driver. A decoder is a
function of bytes and runs in Arrow batches of files, each executor decoding its own.
"""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, qualified, unsized

PACKED = "path string, shape array<int>, affine array<double>, pixdim array<double>, voxels array<float>"

#: NIfTI-1 data type codes.
_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def decode_nifti(raw: bytes) -> dict:
    """SC6, SC17: shape, affine (16 values), pixdim and voxels of a NIfTI-1 file, gzip or not.

    The affine is the sform where its code is set, else the qform, else the voxel sizes; voxel sizes that are not
    positive come from the affine's columns.
    """
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(f"{order}i", raw[:4])[0] != 348 or raw[344:347] not in (b"n+1", b"ni1"):
        raise OSError("no NIfTI-1 file")
    take = lambda f, at: struct.unpack_from(order + f, raw, at)
    dim, code = take("8h", 40), take("h", 70)[0]
    pix, (offset, slope, inter) = take("8f", 76), take("3f", 108)
    q_code, s_code = take("2h", 252)
    shape = [int(n) for n in dim[1 : dim[0] + 1]]
    if s_code > 0:
        affine = np.vstack([np.array(take("12f", 280)).reshape(3, 4), [0, 0, 0, 1]])
    elif q_code > 0:
        b, c, d, x, y, z = take("6f", 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine = np.eye(4)
        affine[:3, :3] = turn * np.array([pix[1], pix[2], pix[3] * (-1 if pix[0] < 0 else 1)])
        affine[:3, 3] = x, y, z
    else:
        affine = np.diag([*[p or 1 for p in pix[1:4]], 1]).astype(float)
    length = np.linalg.norm(affine[:3, :3], axis=0)
    pixdim = [float(p) if p > 0 else float(n) for p, n in zip(pix[1:4], length, strict=True)]
    data = np.frombuffer(raw, order + _TYPES[code], int(np.prod(shape)), int(offset)).reshape(shape, order="F").astype(np.float32)
    if slope and np.isfinite(slope):
        data = data * np.float32(slope) + np.float32(inter)
    return {"shape": shape, "affine": affine.reshape(-1).tolist(), "pixdim": pixdim, "voxels": np.ascontiguousarray(data).reshape(-1)}


def encode_nifti(shape: list[int], voxels: np.ndarray, affine: list[float], pixdim: list[float]) -> bytes:
    """SK3: a NIfTI-1 file of float32; trailing axes of length 1 behind the third are dropped."""
    shape = list(shape)
    while len(shape) > 3 and shape[-1] == 1:
        shape.pop()
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, len(shape), *shape, *[1] * (7 - len(shape)))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *pixdim[:3], 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:12])
    head[344:348] = b"n+1\0"
    data = np.asarray(voxels, "<f4").reshape(shape)
    return bytes(head) + data.tobytes(order="F")


def _decode_with(module: str, load: Callable) -> Callable:
    def decode(raw: bytes) -> dict:
        import importlib

        a = np.asarray(load(importlib.import_module(module), raw), np.float32)
        return {"shape": list(a.shape), "affine": np.eye(4).reshape(-1).tolist(), "pixdim": [1.0, 1.0, 1.0], "voxels": np.ascontiguousarray(a).reshape(-1)}

    return decode


def _pillow(module, raw):
    import io

    return module.open(io.BytesIO(raw))


def _opencv(cv2, raw):
    a = cv2.imdecode(np.frombuffer(raw, np.uint8), cv2.IMREAD_UNCHANGED)
    if a is None:
        raise OSError("no image")
    return a[..., ::-1] if a.ndim == 3 else a


def lps_to_ras(affine: list[float]) -> list[float]:
    """SC10: an affine (16 values) from left-posterior-superior to right-anterior-superior: its first two rows change sign."""
    return [-v if i < 8 else v for i, v in enumerate(affine)]


def decode_sitk(raw: bytes) -> dict:
    """SC10: by SimpleITK, where it is installed: axes in x, y, z order, the affine of origin, spacing and direction in RAS."""
    import os
    import tempfile

    import SimpleITK  # noqa: N813

    with tempfile.TemporaryDirectory() as folder:  # the library reads files only; gone before the batch is
        path = os.path.join(folder, "image.nii.gz" if raw[:2] == b"\x1f\x8b" else "image.nii")
        with open(path, "wb") as f:
            f.write(raw)
        image = SimpleITK.ReadImage(path)
    a = np.asarray(SimpleITK.GetArrayFromImage(image), np.float32).T
    spacing, affine = np.array(image.GetSpacing()), np.eye(4)
    affine[:3, :3] = np.array(image.GetDirection()).reshape(3, 3) * spacing
    affine[:3, 3] = image.GetOrigin()
    return {"shape": list(a.shape), "affine": lps_to_ras(affine.reshape(-1).tolist()), "pixdim": spacing.tolist(), "voxels": np.ascontiguousarray(a).reshape(-1)}


def _skimage(io_, raw):
    import io

    return io_.imread(io.BytesIO(raw))


#: SC12, U3: loaders by name, tried in this order where none is named. Libraries are needed only by who names them.
LOADERS: dict[str, Callable[[bytes], dict]] = {
    "nibabel": decode_nifti,
    "pillow": _decode_with("PIL.Image", _pillow),
    "opencv": _decode_with("cv2", _opencv),
    "skimage": _decode_with("skimage.io", _skimage),
    "simpleitk": decode_sitk,
}


def register_loader(name: str):
    """Adds a decoder (bytes -> dict of shape, affine, pixdim, voxels) under a name."""

    def add(f):
        LOADERS[name] = f
        return f

    return add


def decode(raw: bytes, loader: str | None = None, loaders: dict | None = None) -> dict:
    """SC12: by the named loader, or by the first that can read the bytes."""
    loaders = loaders or LOADERS
    if loader:
        return loaders[loader](raw)
    for f in loaders.values():
        try:
            return f(raw)
        except (OSError, ImportError):  # another format, or its library is not here
            continue
    raise OSError("no loader can read this file")


def read_volumes(spark: SparkSession, path: str, pattern: str | None = None, loader: str | None = None) -> DataFrame:
    """SC6, SC12: packed volumes of the files of a folder. One row a file; column pruning leaves voxels undecoded only
    where the file itself is not read, so select paths before decoding."""
    files = spark.read.format("binaryFile")
    return decoded((files.option("pathGlobFilter", pattern) if pattern else files).load(path).select("path", "content"), loader)


def decoded(files: DataFrame, loader: str | None = None) -> DataFrame:
    """SC6, SC12: packed volumes of files (path, content), decoded in Arrow batches of the tasks that hold them."""
    loaders = dict(LOADERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"path": p, **decode(bytes(c), loader, loaders)} for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["path", "shape", "affine", "pixdim", "voxels"])

    return files.mapInPandas(run, PACKED)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path as Spark names it (not escaped), and the path in it."""
    at = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):(//[^/]*)?(/.*)?$", path, re.DOTALL)
    if at is None or at[1] == "file":
        return fs.LocalFileSystem(), (at[3] or "/") if at else path
    store, base = fs.FileSystem.from_uri(f"{at[1]}:{at[2] or '//'}/")
    return store, base.rstrip("/") + (at[3] or "/")


def reached(path: str) -> bool:
    """Whether tasks can open a path themselves."""
    try:
        store_of(path)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


def _dealt(named: DataFrame) -> DataFrame:
    """(subject_id, path) dealt to tasks by path, equal paths side by side: 4,096 files a task, or fewer."""
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return named.repartition(max(parts, named.count() // 4096 + 1), "path").sortWithinPartitions("path")


def absent(named: DataFrame) -> DataFrame:
    """The paths of (subject_id, path) that no file is at, looked up by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [p for p in dict.fromkeys(batch.column("path").to_pylist()) if _info(p).type != fs.FileType.File]
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.string())], names=["path"])

    def _info(path):
        store, at = store_of(path)
        return store.get_file_info(at)

    return _dealt(named).select("path").mapInArrow(run, "path string")


#: Bytes of voxels, and rows, after which a task hands over what it has decoded.
_FRAME, _ROWS = 1 << 24, 1000


def opened(named: DataFrame, loader: str | None = None) -> DataFrame:
    """SC6, SC12: packed volumes of the listed files (subject_id, path), opened and decoded by the tasks, once for each path."""
    loaders = dict(LOADERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, volume, rows, held = None, {}, [], 0
        for batch in batches:
            for subject, path in zip(batch["subject_id"], batch["path"], strict=True):
                if path != last:
                    store, at = store_of(path)
                    with store.open_input_stream(at, compression=None) as f:
                        last, volume = path, decode(f.read(), loader, loaders)
                rows.append({"path": path, **volume, "subject_id": subject})
                held += 4 * len(volume["voxels"])
                if held >= _FRAME or len(rows) >= _ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    columns = ["path", "shape", "affine", "pixdim", "voxels", "subject_id"]
    return unsized(_dealt(named).mapInPandas(run, f"{PACKED}, subject_id string"))


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """SC7, SC9: PNG, JPEG and the like by Spark's image source, blue-green-red turned to red-green-blue, in the JVM.

    (path, shape [height, width, channels], voxels).
    """
    rows = spark.read.format("image").load(path).select("image.*")
    n = F.col("nChannels")
    byte = lambda i: F.conv(F.hex(F.substring("data", i + 1, F.lit(1))), 16, 10).cast("float")
    swapped = lambda i: F.when(n >= 3, F.when(i % n < 3, i - i % n + 2 - i % n).otherwise(i)).otherwise(i)
    voxels = F.transform(F.sequence(F.lit(0), F.length("data") - 1), lambda i: byte(swapped(i)))
    return rows.select(F.col("origin").alias("path"), F.array("height", "width", "nChannels").alias("shape"), voxels.alias("voxels"))


def nifti_bytes(packed: DataFrame) -> DataFrame:
    """SK3: packed volumes (path, shape, affine, pixdim, voxels) as (path, content), ready for any binary sink."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [encode_nifti(list(s), v, list(a), list(p)) for s, a, p, v in zip(b["shape"], b["affine"], b["pixdim"], b["voxels"], strict=True)]})

    return packed.select("path", "shape", "affine", "pixdim", "voxels").mapInPandas(run, "path string, content binary")


def write_files(named: DataFrame, folder: str) -> DataFrame:
    """One file a row of (path, content) in a folder of a store that pyarrow reaches, written by the tasks; returns (name,
    path), kept by the tasks that wrote them, so that nothing is written twice and no folder is listed. A task that runs
    again writes the same files."""
    whole = qualified(named.sparkSession, folder).rstrip("/")

    def run(batches):
        store, base = store_of(whole)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("path")], names=["name"])

    names = cut(named.select("path", "content").mapInArrow(run, "name string").distinct())
    return names.select("name", F.concat(F.lit(f"{whole}/"), "name").alias("path"))
