"""Cubic splines by line, elastic deformation, and the exact dense CRF (RS4, RS8, F-A5, F-A7, F-A9, RS10).

A spline works on the lines of one axis after the other: a group is one line, an array as long as the axis, so a volume
spreads over all tasks. Only `crf`, the exact kernel for small volumes, takes whole volumes into a task; see `lattice` for
the one that scales.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import portable_key
from .volume import AXES, resample_linear

_c = F.col
#: The pole of the cubic spline's prefilter; its powers are below a double's precision from REACH on.
POLE, REACH = math.sqrt(3) - 2, 60
#: Volumes whose displacements are drawn into one frame.
DRAWN = 500


def _per_volume(vox: DataFrame, keys: list[str], shape, f: Callable[[np.ndarray, tuple], np.ndarray]) -> DataFrame:
    """f(array, key values) -> array for each volume; voxels without a row are 0."""
    names = [*keys, *AXES, "value"]
    kinds = {x.name: x.dataType.simpleString() for x in vox.schema}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(shape)
        a[tuple(pdf[x].to_numpy() for x in AXES)] = pdf["value"].to_numpy()
        out = f(a, key)
        at = np.indices(out.shape).reshape(3, -1)
        return pd.DataFrame({**{k: [v] * out.size for k, v in zip(keys, key, strict=True)}, **{x: at[i].astype("int32") for i, x in enumerate(AXES)}, "value": out.reshape(-1)})[names]

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{a} int" for a in AXES], "value double"])
    return vox.select(*names).groupBy(*keys).applyInPandas(run, schema)


def _mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Places of a line of n voxels that is mirrored at its end voxels, again and again."""
    period = max(1, 2 * n - 2)
    j = np.mod(i, period)
    return np.where(j < n, j, period - j)


def prefiltered(rows: np.ndarray) -> np.ndarray:
    """Lines (one a row) -> coefficients of their cubic splines: one recursion forwards, one backwards."""
    n = rows.shape[1]
    if n == 1:
        return rows
    turn = 2 * n - 2
    k = np.arange(min(turn, REACH))
    out = np.empty_like(rows)
    out[:, 0] = rows[:, _mirrored(k, n)] @ POLE**k / (1 - POLE**turn)
    for i in range(1, n):
        out[:, i] = rows[:, i] + POLE * out[:, i - 1]
    out[:, -1] = POLE / (POLE * POLE - 1) * (out[:, -1] + POLE * out[:, -2])
    for i in range(n - 2, -1, -1):
        out[:, i] = POLE * (out[:, i + 1] - out[:, i])
    return 6 * out


def spline_read(coefficients: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Splines (one a row of coefficients) at real positions: four neighbours each."""
    base = np.floor(at).astype(int)
    t = at - base
    basis = [(1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6]
    n = coefficients.shape[1]
    return sum(w * coefficients[:, _mirrored(base + o, n)] for o, w in zip((-1, 0, 1, 2), basis, strict=True))


def lines(vox: DataFrame, keys: list[str], axis: str, n: Column) -> DataFrame:
    """keys, the other axes, n and the array `line` of n values along an axis; places without a voxel are 0."""
    others = [a for a in AXES if a != axis]
    cells = F.array_sort(F.collect_list(F.struct(_c(axis).alias("at"), _c("value").cast("double").alias("value"))))
    rows = vox.select(*keys, *AXES, "value", n.cast("int").alias("__n")).groupBy(*keys, *others, "__n").agg(cells.alias("cells"))
    some = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["at"], c["value"])))
    spread = F.transform(F.sequence(F.lit(0), _c("__n") - 1), lambda i: F.coalesce(F.try_element_at(some, i), F.lit(0.0)))
    whole = F.transform("cells", lambda c: c["value"])
    return rows.select(*keys, *others, "__n", F.when(F.size("cells") == _c("__n"), whole).otherwise(spread).alias("line"))


def coefficients(vox: DataFrame, keys: list[str], shape) -> DataFrame:
    """The coefficients of the cubic spline through the voxels of each volume: the prefilter, line by line, axis after axis.
    shape: numbers, or columns that are among the keys."""
    for axis, n in zip(AXES, shape, strict=True):
        held = lines(vox, keys, axis, F.lit(n))
        kept = [*keys, *[a for a in AXES if a != axis]]
        rows = held.select(*kept, "line")

        def filtered(batches, kept=kept):
            for pdf in batches:
                out = np.empty(len(pdf), object)
                for _, of in pdf.groupby(pdf["line"].map(len)).indices.items():
                    out[of] = list(prefiltered(np.stack(pdf["line"].to_numpy()[of])))
                yield pdf[kept].assign(out=out)

        schema = T.StructType([*rows.select(*kept).schema, T.StructField("out", T.ArrayType(T.DoubleType()))])
        vox = rows.mapInPandas(filtered, schema).select(*kept, F.posexplode("out").alias(axis, "value")).select(*keys, *AXES, "value")
    return vox


def zoom_axis(vox: DataFrame, keys: list[str], axis: str, n, to) -> DataFrame:
    """The cubic spline through the voxels of each line, read at `to` places between its ends. n, to: numbers or columns."""
    held = lines(vox.withColumn("__to", F.lit(to).cast("int")), [*keys, "__to"], axis, F.lit(n))
    others = [a for a in AXES if a != axis]
    rows = held.select(*keys, *others, "__n", "__to", "line")
    kept = [*keys, *others]

    def read(batches):
        for pdf in batches:
            out = np.empty(len(pdf), object)
            for (n_, to_), of in pdf.groupby(["__n", "__to"]).indices.items():
                places = np.linspace(0, n_ - 1, to_) if to_ > 1 else np.zeros(1)
                out[of] = list(spline_read(prefiltered(np.stack(pdf["line"].to_numpy()[of])), places))
            yield pdf[kept].assign(out=out)

    schema = T.StructType([*rows.select(*kept).schema, T.StructField("out", T.ArrayType(T.DoubleType()))])
    return rows.mapInPandas(read, schema).select(*kept, F.posexplode("out").alias(axis, "value")).select(*keys, *AXES, "value")


def zoom_cubic(vox: DataFrame, keys: list[str], shape, to) -> DataFrame:
    """RS4 with order 3 (F-A5, F-A9): separable cubic splines, corners on corners, three passes over lines.

    shape, to: numbers, or columns that keys determine and that are among the keys.
    """
    for axis, n, t in zip(AXES, shape, to, strict=True):
        vox = zoom_axis(vox, keys, axis, n, t)
    return vox


def normal_field(volumes: DataFrame, keys: list[str], controls: int, sigma: float, seed: int) -> DataFrame:
    """keys, component, x, y, z, value: normal displacements of width sigma at controls^3 places, from seed and key."""
    kinds = {x.name: x.dataType.simpleString() for x in volumes.schema}

    def draw(batches):
        at = np.indices((3, *(controls,) * 3)).reshape(4, -1)
        for pdf in batches:
            for start in range(0, len(pdf), DRAWN):
                part = pdf.iloc[start : start + DRAWN]
                values = []
                for key in part.itertuples(index=False):
                    rng = np.random.default_rng([seed, *[zlib.crc32(str(k).encode()) if not isinstance(k, (int, np.integer)) else int(k) % 2**32 for k in key]])
                    values.append(rng.normal(0, sigma, at.shape[1]))
                out = part.loc[part.index.repeat(at.shape[1])].reset_index(drop=True)
                yield out.assign(**{c: np.tile(i, len(part)).astype("int32") for c, i in zip(("component", *AXES), at, strict=True)}, value=np.concatenate(values))

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "component int", *[f"{a} int" for a in AXES], "value double"])
    return volumes.select(*keys).distinct().mapInPandas(draw, schema)


def portable_field(volumes: DataFrame, key: str, controls: int, sigma: float, seed: int) -> DataFrame:
    """The same table from draws that any SQL engine makes alike (integer keys): two uniforms by a congruential step, one
    normal from both."""
    rows = volumes.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(3 * controls**3 - 1))).alias("i"))
    uniform = lambda k: (F.floor(portable_key(portable_key(_c(key) * 7919 + _c("i") * 104729 + F.lit(k * 1299709 + seed))) / 65536) + 0.5) / 32768
    value = F.lit(float(sigma)) * F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))
    place = [F.expr(f"cast(i div {controls ** (2 - k)} % {controls} as int)").alias(a) for k, a in enumerate(AXES)]
    return rows.select(key, F.expr(f"cast(i div {controls**3} as int)").alias("component"), *place, value.alias("value"))


def elastic(vox: DataFrame, keys: list[str], shape, controls: int = 4, sigma: float = 1.0, seed: int = 0, field: DataFrame | None = None) -> DataFrame:
    """F-A7, RS8: a B-spline field of controls^3 displacements, sampled linearly, edges repeated.

    field: keys, component, x, y, z, value at the control places; by default normal, of width sigma, from seed and key,
    so that a run can be repeated. The field is zoomed to the volume by lines; every voxel then is a point that meets its
    eight neighbours by an equi-join.
    """
    field = normal_field(vox, keys, controls, sigma, seed) if field is None else field
    dense = zoom_cubic(field, [*keys, "component"], (controls,) * 3, shape)
    moved = dense.groupBy(*keys, *AXES).agg(*[F.sum(F.when(_c("component") == i, _c("value"))).alias(f"d{a}") for i, a in enumerate(AXES)])
    points = moved.select(*keys, *[_c(a).alias(f"{a}0") for a in AXES], *[(_c(a) + _c(f"d{a}")).alias(f"p{a}") for a in AXES])
    out = resample_linear(vox, points, keys, shape, "replicate")
    return out.select(*keys, *[_c(f"{a}0").alias(a) for a in AXES], "value")


def crf(vox: DataFrame, keys: list[str], shape, rounds: int = 5, width: float = 1.0, contrast: float = 0.5, weight: float = 1.0, tile: int = 1 << 22) -> DataFrame:
    """RS10: mean-field smoothing of a foreground log-odds map with a gaussian kernel over place and value.

    The kernel is exact. It is never held whole: rows of about `tile` entries are made when they are used, so memory is
    linear in the voxels of a volume; the work stays quadratic, so this is meant for small volumes.
    """

    def smooth(a: np.ndarray, _: tuple) -> np.ndarray:
        place = np.stack(np.indices(shape), axis=-1).reshape(-1, 3).astype(float)
        value = a.reshape(-1)
        step = max(1, tile // len(value))

        def averages(v: np.ndarray) -> np.ndarray:
            out = np.empty(len(v))
            for i in range(0, len(v), step):
                rows = np.exp(-((place[i : i + step, None] - place[None]) ** 2).sum(-1) / (2 * width**2) - (value[i : i + step, None] - value[None]) ** 2 / (2 * contrast**2))
                rows[np.arange(len(rows)), np.arange(i, i + len(rows))] = 0
                out[i : i + step] = rows @ v / np.maximum(rows.sum(axis=1), 1e-12)
            return out

        q = 1 / (1 + np.exp(-value))
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-(value + weight * averages(2 * q - 1))))
        return q.reshape(shape)

    return _per_volume(vox, keys, shape, smooth)
