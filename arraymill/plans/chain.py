"""The preprocessing and augmentation of a run as a chain over volumes of any shape (U14; F-A3 to F-A9, F-M1, F-M4, SC17).

Reading turns a volume to the axes and voxel sizes of its section; then intensities are normalised; then flips, scaling and
rotation are drawn for each subject. The affine parts of each of the two steps are composed into one matrix a subject, as
columns, so each step samples a volume once: one join with the voxels. A step that only permutes axes is arithmetic.

Draws are portable: an unsigned CRC-32 of subject, name and seed, so any engine repeats them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import intensity as I
from ..operators import splines as Z
from ..operators import volume as V
from ..operators.quantiles import same_keys
from ..sources import files
from .spec import PipelineSpec, SourceSpec

_c = F.col
_CELLS = [(r, c) for r in range(3) for c in range(4)]
_WORLD = "RAS"


def uniform(key: str, name: str, seed: int) -> Column:
    """A draw in [0, 1) for each key."""
    return F.crc32(F.concat_ws(":", _c(key).cast("string"), F.lit(name), F.lit(str(seed))).cast("binary")) / F.lit(4294967296.0)


def _within(low: float, high: float, at: Column) -> Column:
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * at


def compose(outer: list[list], inner: list[list]) -> list[list]:
    """The 3 x 4 matrix of inner first, then outer; entries are columns or numbers."""
    out = []
    for r in range(3):
        row = []
        for c in range(4):
            terms = [outer[r][k] * inner[k][c] for k in range(3)]
            row.append(terms[0] + terms[1] + terms[2] + (outer[r][3] if c == 3 else 0.0))
        out.append(row)
    return out


def _diagonal(values, offsets=(0.0, 0.0, 0.0)) -> list[list]:
    return [[values[r] if r == c else 0.0 for c in range(3)] + [offsets[r]] for r in range(3)]


def rotation_columns(angles: list[Column], shape) -> list[list]:
    """F-A4 for columns: rotations about x, y, z (degrees; z * x * y) around the centre of a volume."""
    (ca, sa), (cb, sb), (cc, sc) = [(F.cos(F.radians(a)), F.sin(F.radians(a))) for a in angles]
    turn = [[cc * cb - sc * sa * sb, -sc * ca, cc * sb + sc * sa * cb], [sc * cb + cc * sa * sb, cc * ca, sc * sb - cc * sa * cb], [-ca * sb, sa, ca * cb]]
    centre = [(n - 1) / 2 for n in shape]
    return [[*row, centre[r] - (row[0] * centre[0] + row[1] * centre[1] + row[2] * centre[2])] for r, row in enumerate(turn)]


def sampled(vox: DataFrame, volumes: DataFrame, key: str, matrix: list[list], to: list[Column], order: int = 1, mode: str = "replicate") -> DataFrame:
    """A view on new grids: a place of `to` voxels shows the volume at the affine image of it.

    volumes: a row a volume with key, nx, ny, nz and what matrix and to are made of. Voxels without a time point or
    modality are those of one. Order 3 is the cubic spline's prefilter by lines and its 64 neighbours.
    """
    channels = [c for c in ("t", "m") if c in vox.columns]
    held = volumes.select(key, *V.SIZES, *[(m if isinstance(m, Column) else F.lit(float(m))).cast("double").alias(f"__m{r}{c}") for (r, c), m in ((rc, matrix[rc[0]][rc[1]]) for rc in _CELLS)], *[t.cast("int").alias(f"__to{a}") for a, t in zip(V.AXES, to, strict=True)])
    if channels:
        held = held.join(vox.select(key, *channels).distinct(), key)
    for a in V.AXES:
        held = held.withColumn(f"{a}0", F.explode(F.sequence(F.lit(0), _c(f"__to{a}") - 1)))
    points = [(_c(f"__m{r}0") * _c("x0") + _c(f"__m{r}1") * _c("y0") + _c(f"__m{r}2") * _c("z0") + _c(f"__m{r}3")).alias(f"p{a}") for r, a in enumerate(V.AXES)]
    points = held.select(key, *channels, *V.SIZES, *[f"__to{a}" for a in V.AXES], "x0", "y0", "z0", *points)
    keys, shape = V.sized([key, *channels])
    if order == 3:
        vox = Z.coefficients(vox, keys, shape)
    resample = {0: V.resample_nearest, 1: V.resample_linear, 3: V.resample_bspline}[order]
    out = resample(vox, points, keys, shape, "symmetric" if order == 3 else mode)
    return out.select(key, *channels, *[_c(f"__to{a}").alias(n) for a, n in zip(V.AXES, V.SIZES, strict=True)], *[_c(f"{a}0").alias(a) for a in V.AXES], "value")


def _axis_of(affine: Column, axis: int) -> tuple[Column, Column]:
    """SC17: the world axis that a voxel axis runs along most, and whether it runs up it."""
    cells = [F.get(affine, F.lit(4 * r + axis)) for r in range(3)]
    size = [F.abs(c) for c in cells]
    world = F.when((size[0] >= size[1]) & (size[0] >= size[2]), 0).when(size[1] >= size[2], 1).otherwise(2)
    return world, F.get(F.array(*cells), world) > 0


def as_read(vox: DataFrame, volumes: DataFrame, source: SourceSpec, key: str) -> tuple[DataFrame, DataFrame]:
    """F-A8, F-A9: the axes and voxel sizes of a section; the view, and volumes with their new sizes.

    volumes: key, nx, ny, nz, affine, pixdim. Axes go to the world axis that they run along most. Where voxel sizes are
    given, the grid spans the same corners with round(n * old / new) voxels, and turning and resampling are one sampling.
    """
    if not source.axcodes and not source.pixdim:
        return vox, volumes
    target = "".join(source.axcodes) or _WORLD
    found = [_axis_of(_c("affine"), i) for i in range(3)]
    volumes = volumes.withColumns({**{f"__w{i}": w for i, (w, _) in enumerate(found)}, **{f"__u{i}": u for i, (_, u) in enumerate(found)}})
    from_, flipped, size, step = [], [], [], []
    for code in target:
        world, up = V._SIDES[code][0], V._SIDES[code][1] > 0
        if source.axcodes:
            at = F.when(_c("__w0") == world, 0).when(_c("__w1") == world, 1).otherwise(2)
            turned = F.get(F.array("__u0", "__u1", "__u2"), at) != F.lit(up)
        else:
            at, turned = F.lit(len(from_)), F.lit(False)
        from_.append(at)
        flipped.append(turned)
        size.append(F.get(F.array(*V.SIZES), at))
        step.append(F.get("pixdim", at))
    wanted = [*source.pixdim, *[source.pixdim[-1]] * 3][:3] if source.pixdim else None
    to = [F.greatest(F.lit(1), F.bround(n * s / F.lit(float(p)))) for n, s, p in zip(size, step, wanted, strict=True)] if wanted else size
    new = [F.lit(float(p)).cast("double") for p in wanted] if wanted else step
    named = volumes.withColumns({**{f"__f{i}": f for i, f in enumerate(from_)}, **{f"__d{i}": f for i, f in enumerate(flipped)}, **{f"__n{i}": t.cast("int") for i, t in enumerate(to)}, **{f"__p{i}": p for i, p in enumerate(new)}})
    after = named.select(key, *[_c(f"__n{i}").alias(n) for i, n in enumerate(V.SIZES)], "affine", F.array("__p0", "__p1", "__p2").alias("pixdim"))
    if not wanted:
        rows = same_keys(vox, named.select(key, *[f"__f{i}" for i in range(3)], *[f"__d{i}" for i in range(3)]), [key])
        place = [F.get(F.array(*V.AXES), _c(f"__f{i}")) for i in range(3)]
        sizes = [F.get(F.array(*V.SIZES), _c(f"__f{i}")) for i in range(3)]
        moved = [F.when(_c(f"__d{i}"), sizes[i] - 1 - place[i]).otherwise(place[i]).alias(a) for i, a in enumerate(V.AXES)]
        channels = [c for c in ("t", "m") if c in vox.columns]
        return rows.select(key, *channels, *[s.alias(n) for s, n in zip(sizes, V.SIZES, strict=True)], *moved, "value"), after
    # a new place runs along axis f of the source, from its far end where it is flipped
    matrix = []
    for axis, n in enumerate(V.SIZES):
        row, offset = [], F.lit(0.0)
        for i in range(3):
            along = _c(f"__f{i}") == axis
            pace = F.when(_c(f"__n{i}") > 1, (_c(n) - 1) / (_c(f"__n{i}") - 1)).otherwise(0.0)
            row.append(F.when(along, F.when(_c(f"__d{i}"), -pace).otherwise(pace)).otherwise(0.0))
            offset = offset + F.when(along & _c(f"__d{i}"), (_c(n) - 1).cast("double")).otherwise(0.0)
        matrix.append([*row, offset])
    return sampled(vox, named, key, matrix, [_c(f"__n{i}") for i in range(3)], source.interp_order), after


def normalised(spec: PipelineSpec, vox: DataFrame, key: str, spark=None) -> DataFrame:
    """F-M1, F-M4, F-M5, AG62-AG64: histogram normalisation to the mapping of histogram_ref_file, or of these volumes where
    none is given, then whitening; both over the foreground, if so set. By subject, time point and modality."""
    net = spec.sections["NETWORK"]
    keys = [key, *[c for c in ("t", "m") if c in vox.columns], *[c for c in V.SIZES if c in vox.columns]]
    by = [c for c in ("t", "m") if c in vox.columns]

    def masked(rows):
        return I.foreground(rows, keys, "value", net.foreground_type).where("mask") if net.normalise_foreground_only else rows

    if net.normalisation:
        marks = I.landmarks(masked(vox), keys, "value", net.cutoff, net.norm_type)
        if net.histogram_ref_file:
            model = files.read_model(vox.sparkSession, net.histogram_ref_file).select("key", _c("landmarks").alias("mapping"))
            names = F.concat_ws("_", *[_c(b).cast("string") for b in by]) if by else F.lit("0")
            mapping = marks.select(*by).distinct().withColumn("key", names).join(model, "key").drop("key") if by else model.where("key = '0'").drop("key")
        else:
            mapping = I.averaged_mapping(marks, by)
        joined = same_keys(same_keys(vox, marks, keys, "left"), mapping, by, "left") if by else same_keys(vox, marks, keys, "left").join(mapping, F.lit(True), "left")
        vox = I.mapped(joined, "value", net.norm_type, "__standard").drop("value").withColumnRenamed("__standard", "value").select(*keys, *V.AXES, "value")
    if net.whitening:
        inside = None
        if net.normalise_foreground_only:
            vox, inside = I.foreground(vox, keys, "value", net.foreground_type), _c("mask")
        vox = I.whitened(vox, keys, "value", inside).drop("value", "mask").withColumnRenamed("white", "value").select(*keys, *V.AXES, "value")
    return vox


def _angles(spec: PipelineSpec, key: str, seed: int) -> list[Column] | None:
    train = spec.sections["TRAINING"]
    ranges = [train.rotation_angle] * 3 if train.rotation_angle else [train.rotation_angle_x, train.rotation_angle_y, train.rotation_angle_z]
    if not any(ranges):
        return None
    return [_within(min(r), max(r), uniform(key, f"angle{i}", seed)) if r else F.lit(0.0) for i, r in enumerate(ranges)]


def augmented(spec: PipelineSpec, vox: DataFrame, key: str, seed: int = 0, order: int = 1) -> DataFrame:
    """F-A3, F-A4, F-A5, F-A6, F-A7, U6: flips (a chance of one half an axis), scaling and rotation as one sampling, then a
    bias field and an elastic deformation, drawn for each subject; nothing where nothing is set.

    Volumes carry nx, ny, nz; scaling changes them to round(n * factor). Volumes that shrink on all axes are smoothed first
    if antialiasing is on.
    """
    train = spec.sections["TRAINING"]
    flips = [a for a in train.random_flipping_axes if a >= 0]
    angles = _angles(spec, key, seed)
    if flips or train.scaling_percentage or angles:
        volumes = vox.select(key, *V.SIZES).distinct()
        factor = [F.lit(1.0)] * 3
        if train.scaling_percentage:
            low, high = max(min(train.scaling_percentage), -99.9), max(train.scaling_percentage)
            factor = [(_within(low, high, uniform(key, "scale" if train.isotropic_scaling else f"scale{i}", seed)) + 100.0) / 100.0 for i in range(3)]
        volumes = volumes.withColumns({f"__z{i}": f for i, f in enumerate(factor)})
        if train.scaling_percentage and train.antialiasing and min(train.scaling_percentage) < 0:
            vox = _antialiased(vox, volumes, key, min(train.scaling_percentage))
        to = [F.greatest(F.lit(1), F.bround(_c(n) * _c(f"__z{i}"))).cast("int") for i, n in enumerate(V.SIZES)]
        volumes = volumes.withColumns({f"__g{i}": t for i, t in enumerate(to)})
        grown = [_c(f"__g{i}") for i in range(3)]
        pace = [F.when(g > 1, (_c(n) - 1) / (g - 1)).otherwise(0.0) for g, n in zip(grown, V.SIZES, strict=True)]
        turned = [(uniform(key, f"flip{i}", seed) < 0.5) if i in flips else F.lit(False) for i in range(3)]
        matrix = _diagonal([F.when(f, -p).otherwise(p) for f, p in zip(turned, pace, strict=True)], [F.when(f, (_c(n) - 1).cast("double")).otherwise(0.0) for f, n in zip(turned, V.SIZES, strict=True)])
        if angles:
            matrix = compose(matrix, rotation_columns(angles, grown))
        vox = sampled(vox, volumes, key, matrix, grown, order)
    keys = [key, *[c for c in ("t", "m") if c in vox.columns], *V.SIZES]
    if train.bias_field_range:
        low, high = min(train.bias_field_range), max(train.bias_field_range)
        powers = [(i, j, k) for i in range(train.bf_order + 1) for j in range(train.bf_order + 1 - i) for k in range(train.bf_order + 1 - i - j)]
        at = [_c(a) / F.greatest(_c(n) - 1, F.lit(1)).cast("double") for a, n in zip(V.AXES, V.SIZES, strict=True)]
        total = F.lit(0.0)
        for p in powers:
            total = total + _within(low, high, uniform(key, f"bias{p[0]}{p[1]}{p[2]}", seed)) * F.pow(at[0], F.lit(p[0])) * F.pow(at[1], F.lit(p[1])) * F.pow(at[2], F.lit(p[2]))
        vox = vox.withColumn("value", _c("value") * F.exp(total))
    if train.do_elastic_deformation:
        deformed = uniform(key, "deform", seed) < F.lit(float(train.proportion_to_deform))
        moved = Z.elastic(vox.where(deformed), keys, tuple(_c(n) for n in V.SIZES), train.num_ctrl_points, train.deformation_sigma, seed)
        vox = vox.where(~deformed).unionByName(moved.select(*vox.columns))
    return vox


def _antialiased(vox: DataFrame, volumes: DataFrame, key: str, low: float, truncate: float = 4.0) -> DataFrame:
    """F-A5: volumes whose factors are all below 1 smoothed by a gaussian of the width that each factor asks for.

    The widest kernel that the range allows bounds the windows; a narrower volume's outer weights are 0.
    """
    widest = math.sqrt((100 / (max(low, -99.9) + 100)) ** 2 - 1) / (2 * math.sqrt(2 * math.log(2)))
    tail = int(truncate * widest + 0.5)
    if not tail:
        return vox
    keys, shape = V.sized([key, *[c for c in ("t", "m") if c in vox.columns]])
    small = (_c("__z0") < 1) & (_c("__z1") < 1) & (_c("__z2") < 1)
    rows = same_keys(V.pad(vox, keys, shape, (tail,) * 3, "symmetric"), volumes.select(key, "__z0", "__z1", "__z2"), [key])
    all_keys = [*keys, "__z0", "__z1", "__z2"]
    for i, a in enumerate(V.AXES):
        sigma = F.sqrt(F.pow(1 / _c(f"__z{i}"), 2) - 1) / (2 * math.sqrt(2 * math.log(2)))
        reach = F.floor(truncate * sigma + 0.5)
        weight = [F.when(F.lit(abs(k)) <= reach, F.exp(-0.5 * F.pow(F.lit(float(k)) / sigma, 2))).otherwise(0.0) if k else F.lit(1.0) for k in range(-tail, tail + 1)]
        rows = rows.withColumn("__total", sum(weight, F.lit(0.0)))
        rows = V._smooth_axis(rows, [*all_keys, "__total"], a, [F.when(small, w / _c("__total")).otherwise(1.0 if k == tail else 0.0) for k, w in enumerate(weight)]).drop("__total")
    return V.crop(rows, {a: tail for a in V.AXES}, {a: n + tail for a, n in zip(V.AXES, shape, strict=True)}).select(*vox.columns)


def refuse_unknown(spec: PipelineSpec) -> None:
    """Keys that this chain has no meaning for are an error where they are set; queue_length has none in Spark."""
    net = spec.sections["NETWORK"]
    bad = [n for n, on in (("rgb_normalisation", net.rgb_normalisation), ("volume_padding_to_size", any(net.volume_padding_to_size))) if on]
    if bad:
        raise ValueError(f"not applied in a run over volumes of their own shapes: {', '.join(bad)}")
