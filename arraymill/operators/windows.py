"""Spatial windows: coordinates, samplers, batches and reassembly (WS1-WS23, J14-J17, PF12, PF16, AG75-AG77, SO2-SO5)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import global_rank, portable_key
from .volume import AXES, pad

_c = F.col


def step_points(end: int, window: int, step: int) -> list[int]:
    """WS1: 0, step, ... while the window fits, then end - window; of exactly two points, their half-even mean comes last."""
    points = list(range(0, end - window + 1, step)) if step > 0 and end - window >= 0 else []
    points = list(dict.fromkeys([*points, max(end - window, 0)]))
    if len(points) == 2:
        points.append(round(sum(points) / 2))
    return list(dict.fromkeys(points))


def step_points_column(end: Column, window: int, step: int) -> Column:
    """WS1 for a size column."""
    last = F.greatest(end - window, F.lit(0)).cast("int")
    run = F.when(end >= window, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>")) if step > 0 else F.array().cast("array<int>")
    points = F.array_distinct(F.concat(run, F.array(last)))
    middle = F.bround((F.get(points, F.lit(0)) + F.get(points, F.lit(1))) / 2.0).cast("int")
    return F.when(F.size(points) == 2, F.array_distinct(F.concat(points, F.array(middle)))).otherwise(points)


def grid_windows(images: DataFrame, key: str, window: tuple[int, int, int], border: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """WS2, WS3: (key, seq, x0, y0, z0, x1, y1, z1) for images (key, X, Y, Z); ends are exclusive.

    seq runs over y outermost, then x, then z, each in step order. An image smaller than the window is an error.
    """
    small = images.where((_c("X") < window[0]) | (_c("Y") < window[1]) | (_c("Z") < window[2]))
    if not small.isEmpty():
        raise ValueError("window larger than an image")
    rows = images.select(key, *[_starts(a, w, b) for a, w, b in zip(AXES, window, border, strict=True)])
    for a in ("y", "x", "z"):
        rows = rows.select("*", F.posexplode(f"{a}s").alias(f"i{a}", f"{a}0"))
    seq = (_c("iy") * F.size("xs") + _c("ix")) * F.size("zs") + _c("iz")
    return rows.select(key, seq.cast("int").alias("seq"), "x0", "y0", "z0", *[(_c(f"{a}0") + w).cast("int").alias(f"{a}1") for a, w in zip(AXES, window, strict=True)])


def _step(window: int, border: int) -> int:
    return max(1, max(window - 2 * max(border, 0), 0))


def _starts(axis: str, window: int, border: int) -> Column:
    return step_points_column(_c(axis.upper()), window, _step(window, border)).alias(f"{axis}s")


def cut_windows(vox: DataFrame, images: DataFrame, key: str, window: tuple[int, int, int], border: tuple[int, int, int] = (0, 0, 0), carry: tuple[str, ...] = ()) -> DataFrame:
    """WS3, J17: voxels of every grid window, with x, y, z inside the window and its seq and x0, y0, z0, and the columns
    to carry (t and m, say).

    A voxel meets its image by an equi-join on the key and finds the windows that cover it by arithmetic: the first and
    the last step that reach it, and the start at the far end. It is exploded to these alone, and no range join is made.
    """
    sizes = images.select(key, *[_c(a.upper()).alias(f"__{a}") for a in AXES])
    rows = vox.join(sizes, key)
    for a, w, b in zip(AXES, window, border, strict=True):
        rows = rows.withColumn(f"i{a}", F.explode(covering(_c(a), _c(f"__{a}"), w, _step(w, b))))
    start = {a: start_of(_c(f"i{a}"), _c(f"__{a}"), w, _step(w, b)) for a, w, b in zip(AXES, window, border, strict=True)}
    count = {a: _axis(_c(f"__{a}"), w, _step(w, b))[-1] for a, w, b in zip(AXES, window, border, strict=True)}
    seq = (_c("iy") * count["x"] + _c("ix")) * count["z"] + _c("iz")
    return rows.select(key, *carry, seq.cast("int").alias("seq"), *[start[a].alias(f"{a}0") for a in AXES], *[(_c(a) - start[a]).alias(a) for a in AXES], "value")


def _axis(end: Column, window: int, step: int) -> tuple[Column, Column, Column, Column, Column, Column]:
    """Of one axis: the last start, the number of the last regular one, whether the last is another one, the middle of
    exactly two starts, whether it is a third one, and the number of starts. Regular starts are 0, step, 2 step, ..."""
    last = F.greatest(end - window, F.lit(0)).cast("int")
    steps = F.floor(last / step).cast("int")
    odd = last % step != 0
    middle = F.bround(last / 2.0).cast("int")
    third = (steps + odd.cast("int") == 1) & (middle != 0) & (middle != last)
    return last, steps, odd, middle, third, steps + 1 + odd.cast("int") + third.cast("int")


def covering(at: Column, end: Column, window: int, step: int) -> Column:
    """The numbers, in step order, of the windows of one axis of size `end` that cover place `at`: an array.

    They are one run from the first step that reaches the place to the last, the start at the far end being the step
    after the regular ones, and the middle of exactly two starts.
    """
    last, steps, odd, middle, third, _ = _axis(end, window, step)
    low = F.greatest(F.ceil((at - window + 1) / step), F.lit(0)).cast("int")
    high = F.when(odd & (at >= last), steps + 1).otherwise(F.least(F.floor(at / step), steps)).cast("int")
    run = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.when(third & (at >= middle) & (at < middle + window), F.concat(run, F.array(F.lit(2)))).otherwise(run)


def start_of(number: Column, end: Column, window: int, step: int) -> Column:
    """The start of the window with that number in step order."""
    last, _, _, middle, third, _ = _axis(end, window, step)
    return F.when(third & (number == 2), middle).otherwise(F.least(number * step, last)).cast("int")


def crop_windows(cut: DataFrame, window: tuple[int, int, int], border: tuple[int, int, int]) -> DataFrame:
    """PF12: window voxels without the border; an axis whose border would leave nothing keeps all."""
    for a, w, b in zip(AXES, window, border, strict=True):
        if b > 0 and 2 * b < w:
            cut = cut.where((_c(a) >= b) & (_c(a) < w - b))
    return cut


def assemble(cut: DataFrame, spine: DataFrame, key: str, fill: float = 0.0, channels: tuple[str, ...] = ()) -> DataFrame:
    """AG75: window voxels back in their volumes: the window with the largest seq wins, uncovered voxels get `fill`.

    spine: (key, x, y, z) of the volumes. channels: columns of the windows (t and m, say) that tell the values of one voxel
    apart; a volume has all places in each of its channels. One aggregate, then a left join from the spine.
    """
    placed = cut.select(key, *channels, "seq", *[(_c(a) + _c(f"{a}0")).cast("int").alias(a) for a in AXES], "value")
    last = placed.groupBy(key, *channels, *AXES).agg(F.max_by("value", "seq").alias("value"))
    whole = spine.select(key, *AXES)
    if channels:
        whole = whole.join(cut.select(key, *channels).distinct(), key).select(key, *channels, *AXES)
    return whole.join(last, [key, *channels, *AXES], "left").withColumn("value", F.coalesce("value", F.lit(float(fill))))


def window_rows_csv(rows: DataFrame, values: list[str]) -> DataFrame:
    """AG76: one row a window: values, then the location, in coord_0 .. coord_6."""
    at = ["image_id", "x0", "y0", "z0", "x1", "y1", "z1"]
    return rows.select(*[_c(v).alias(f"key_{i}") for i, v in enumerate(values)], *[_c(a).alias(f"coord_{i}") for i, a in enumerate(at)])


def numbered_outputs(rows: DataFrame, subject: str, order: list[str], name: str) -> DataFrame:
    """AG77: one output name a window: <running index of the subject>_<subject>_<name>."""
    i = F.row_number().over(Window.partitionBy(subject).orderBy(*order)) - 1
    return rows.withColumn("output", F.concat_ws("_", i.cast("string"), _c(subject).cast("string"), F.lit(name)))


def draws(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Draw numbers 0 .. n - 1 of every row."""
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).withColumn("seed", F.lit(seed))


def _uniform(key: str, axis: int) -> Column:
    """A portable pseudo-random integer of (key, draw, axis, seed)."""
    once = portable_key(_c(key) * 7919 + _c("draw") * 104729 + axis * 1299709 + _c("seed"))
    return F.floor(portable_key(once) / 65536).cast("long")


def uniform_windows(images: DataFrame, key: str, window: tuple[int, int, int], n: int, seed: int = 0) -> DataFrame:
    """WS4, WS5: n windows an image, starts uniform where the window fits; reproducible from key, draw and seed."""
    rows = draws(images, key, n, seed)
    starts = [F.pmod(_uniform(key, i), F.greatest(_c(a.upper()) - w + 1, F.lit(1))).cast("int").alias(f"{a}0") for i, (a, w) in enumerate(zip(AXES, window, strict=True))]
    rows = rows.select(key, "draw", *starts)
    return rows.select("*", *[(_c(f"{a}0") + w).alias(f"{a}1") for a, w in zip(AXES, window, strict=True)])


def feasible(vox: DataFrame, shape: tuple[int, int, int], window: tuple[int, int, int]) -> DataFrame:
    """WS8: voxels that can be a window's centre."""
    for a, n, w in zip(AXES, shape, window, strict=True):
        low = w // 2
        vox = vox.where(_c(a).between(low, low + n - w))
    return vox


def weighted_centres(vox: DataFrame, keys: list[str], shape, window, n: int, offset: float = 0.5) -> DataFrame:
    """WS7: n centres a volume from the cumulative histogram of its values; draw k takes the first value whose
    cumulated share reaches 1 - (k + offset) / n. Negative maps are shifted to 0, constant zero maps are uniform.
    """
    rows = feasible(vox, shape, window)
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("__v", _c("value") - F.least(F.min("value").over(whole), F.lit(0.0)))
    rows = rows.withColumn("__v", F.when(F.sum("__v").over(whole) == 0, F.lit(1.0)).otherwise(_c("__v")))
    order = Window.partitionBy(*keys).orderBy("__v", *AXES)
    share = F.sum("__v").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("__v").over(whole)
    before = F.coalesce(F.lag("__p").over(order), F.lit(0.0))
    rows = rows.withColumn("__p", share).withColumn("__q", before)
    # the draws in (q, p]: k from ceil(n (1 - p) - offset) to below n (1 - q) - offset
    first, last = F.greatest(F.ceil(F.round(n * (1 - _c("__p")) - offset, 9)), F.lit(0)), F.least(F.ceil(F.round(n * (1 - _c("__q")) - offset, 9)) - 1, F.lit(n - 1))
    hit = rows.where(first <= last).select(*keys, *AXES, F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("draw"))
    return hit.select(*keys, "draw", *AXES)


def balanced_probabilities(vox: DataFrame, keys: list[str], label: str = "value") -> DataFrame:
    """WS9: the probability of each voxel as a centre: equal for all labels, uniform inside a label."""
    counts = vox.groupBy(*keys, label).agg(F.count("*").alias("__n"))
    labels = counts.groupBy(*keys).agg(F.count("*").alias("__l"))
    return vox.join(counts, [*keys, label]).join(labels, keys).withColumn("p", 1.0 / (_c("__n") * _c("__l"))).drop("__n", "__l")


def balanced_centres(vox: DataFrame, keys: list[str], shape, window, n: int, offset: float = 0.5) -> DataFrame:
    """WS9: n centres by those probabilities."""
    rows = balanced_probabilities(feasible(vox, shape, window), keys)
    return weighted_centres(rows.withColumn("value", _c("p")).drop("p"), keys, shape, window, n, offset)


def box_sums(vox: DataFrame, keys: list[str], window: tuple[int, int, int], value: str = "value") -> DataFrame:
    """Sums over the window that starts at each voxel, where it fits: one window frame an axis."""
    for a, w in zip(AXES, window, strict=True):
        frame = Window.partitionBy(*keys, *[x for x in AXES if x != a]).orderBy(a)
        inner = frame.rowsBetween(0, w - 1)
        vox = vox.withColumn("__s", F.sum(value).over(inner)).withColumn("__n", F.count(value).over(inner)).where(_c("__n") == w).drop(value, "__n").withColumnRenamed("__s", value)
    return vox


@dataclass(frozen=True)
class Constraint:
    """WS16: labels a window must hold, the least share of each, and the least number of labels."""

    labels: tuple[int, ...] = ()
    min_ratio: float = 0.0
    min_labels: int = 1


def selective_candidates(vox: DataFrame, keys: list[str], window: tuple[int, int, int], constraint: Constraint, classes: list[int]) -> DataFrame:
    """WS13: window starts whose window holds every compulsory label in the least share and enough labels."""
    size = window[0] * window[1] * window[2]
    rows = vox
    for k in classes:
        rows = rows.withColumn(f"__c{k}", (_c("value") == k).cast("long"))
    rows = rows.drop("value")
    for a, w in zip(AXES, window, strict=True):
        inner = Window.partitionBy(*keys, *[x for x in AXES if x != a]).orderBy(a).rowsBetween(0, w - 1)
        rows = rows.select(*keys, *AXES, *[F.sum(f"__c{k}").over(inner).alias(f"__c{k}") for k in classes], F.count("*").over(inner).alias("__n")).where(_c("__n") == w).drop("__n")
    n_labels = sum(((_c(f"__c{k}") > 0).cast("int") for k in classes), F.lit(0))
    ok = n_labels >= constraint.min_labels
    for k in constraint.labels:
        ok = ok & (_c(f"__c{k}") > 0) & (_c(f"__c{k}") >= constraint.min_ratio * size)
    return rows.where(ok).select(*keys, *AXES, n_labels.cast("int").alias("n_labels"))


def size_weights(sizes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """WS14: candidate probabilities, the reciprocal of how many candidates share their size, normalised by group."""
    counts = sizes.groupBy(*keys, size).agg(F.count("*").alias("__n"))
    kinds = counts.groupBy(*keys).agg(F.count("*").alias("__k"))
    return sizes.join(counts, [*keys, size]).join(kinds, keys).withColumn("p", 1.0 / (_c("__n") * _c("__k"))).drop("__n", "__k")


def weighted_choice(rows: DataFrame, keys: list[str], weight: str, unique: str, n: int, seed: int = 0) -> DataFrame:
    """WS15: n rows a group without replacement, by an exponential race on a portable pseudo-random number."""
    u = (portable_key(portable_key(_c(unique) * 7919 + seed)) + 1) / F.lit(2147483649.0)
    race = -F.log(u) / F.when(_c(weight) > 0, _c(weight))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("__r"), unique))
    return rows.withColumn("__r", race).withColumn("__k", k).where((_c("__k") <= n) & _c("__r").isNotNull()).drop("__r", "__k")


def interpolated(pairs: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """WS11: x * m + y * (1 - m) of two arrays for n values m from 0 to 1."""
    m = F.explode(F.array(*[F.lit(i / (n - 1) if n > 1 else 0.0) for i in range(n)]))
    rows = pairs.select("*", m.alias("m"))
    return rows.withColumn("vector", F.transform(F.arrays_zip(_c(a).alias("x"), _c(b).alias("y")), lambda s: s["x"] * _c("m") + s["y"] * (1 - _c("m")))).drop(a, b)


def random_vectors(spark, n: int, size: int, seed: int = 0) -> DataFrame:
    """WS12, SC11: seeded normal vectors."""
    return spark.range(n).select("id", F.array(*[F.randn(seed * 1000 + i) for i in range(size)]).alias("vector"))


def csv_patches(centres: DataFrame, images: DataFrame, key: str, window: tuple[int, int, int], mode: str = "pad") -> DataFrame:
    """WS17, PF16: windows around given centres; columns pad_<axis>_low/high say what lies outside the image.

    Modes: pad keeps all, remove drops windows that do not fit, rand or random replaces them by uniform windows.
    """
    rows = centres.join(images.select(key, *[_c(a.upper()).alias(f"size_{a}") for a in AXES]), key)
    for a, w in zip(AXES, window, strict=True):
        rows = rows.withColumn(f"{a}0", (_c(a) - w // 2).cast("int"))
        rows = rows.withColumn(f"pad_{a}_low", F.greatest(-_c(f"{a}0"), F.lit(0))).withColumn(f"pad_{a}_high", F.greatest(_c(f"{a}0") + w - _c(f"size_{a}"), F.lit(0)))
    rows = rows.withColumn("valid", sum((_c(f"pad_{a}_{s}") for a in AXES for s in ("low", "high")), F.lit(0)) == 0)
    if mode == "remove":
        return rows.where("valid")
    if mode in ("rand", "random"):
        fresh = {a: F.pmod(_uniform(key, i), F.greatest(_c(f"size_{a}") - w + 1, F.lit(1))).cast("int") for i, (a, w) in enumerate(zip(AXES, window, strict=True))}
        rows = rows.withColumn("draw", F.lit(0)).withColumn("seed", F.lit(0))
        for a in AXES:
            rows = rows.withColumn(f"{a}0", F.when(_c("valid"), _c(f"{a}0")).otherwise(fresh[a]))
        return rows.drop("draw", "seed")
    if mode != "pad":
        raise ValueError(f"unknown mode: {mode}")
    return rows


def window_sizes(wanted: list[int | None], image: list[int]) -> list[int]:
    """WS23: a window size completed from the image where a dimension is missing, zero or negative."""
    return [w if w and w > 0 else n for w, n in zip([*wanted, *[None] * (len(image) - len(wanted))], image, strict=True)]


def completed_window(wanted: list[Column], image: list[Column]) -> list[Column]:
    """WS23 for columns: each size, or the image's where it is missing, zero or negative."""
    return [F.when(w > 0, w).otherwise(n).cast("int") for w, n in zip(wanted, image, strict=True)]


def largest_windows(windows: DataFrame, keys: list[str]) -> DataFrame:
    """WS6 for a table of windows (keys, x, y, z): the largest size on each axis by key."""
    return windows.groupBy(*keys).agg(*[F.max(a).alias(a) for a in AXES])


def largest_window(sizes: list[list[int]]) -> list[int]:
    """WS6: the largest size on each axis."""
    return [max(x) for x in zip(*sizes, strict=True)]


def whole_image(images: DataFrame, key: str) -> DataFrame:
    """WS22: one window a whole image."""
    return images.select(key, *[F.lit(0).alias(f"{a}0") for a in AXES], *[_c(a.upper()).alias(f"{a}1") for a in AXES])


def batches(rows: DataFrame, index: str, size: int, mode: str = "dynamic") -> DataFrame:
    """SO5: a batch number from a 0-based row index; the last batch is kept, dropped, or filled with rows of -1."""
    out = rows.withColumn("batch", F.floor(_c(index) / size))
    if mode == "dynamic":
        return out
    counts = out.groupBy("batch").agg(F.count("*").alias("n"))
    if mode == "drop":
        return out.join(counts.where(f"n = {size}").select("batch"), "batch", "left_semi").select(*out.columns)
    if mode != "pad":
        raise ValueError(f"unknown mode: {mode}")
    short = counts.where(f"n < {size}").select("batch", F.explode(F.sequence(_c("n") + 1, F.lit(size))).alias("__i"))
    empty = short.select(*[_c("batch") if f.name == "batch" else F.lit(-1).cast(f.dataType).alias(f.name) for f in out.schema])
    return out.unionByName(empty)


def repeated(rows: DataFrame, epochs: int) -> DataFrame:
    """SO4: every row once an epoch."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def shuffled(rows: DataFrame, key: str, seed: int = 0, buffer: int | None = None, order: str | None = None) -> DataFrame:
    """SO3: rows with a seeded `position` 0, 1, ...: a portable pseudo-random order of all rows, or, with a buffer, the
    order of an integer column in which a row moves ahead only of rows less than `buffer` places before it.
    """
    u = portable_key(portable_key(_c(key) * 7919 + seed))
    by = [u, _c(key)] if buffer is None else [_c(order) * F.lit(2147483648) + u * F.lit(buffer), _c(order)]
    return global_rank(rows, by).withColumn("position", _c("rank") - 1).drop("rank")


def mix_match(rows: DataFrame, group: str, key: str, volume: str) -> DataFrame:
    """SO2: inside a group, the smallest volume meets the largest, and so on: (group, a, b)."""
    up = F.row_number().over(Window.partitionBy(group).orderBy(volume, key))
    down = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(volume), F.desc(key)))
    ranked = rows.select(group, key, up.alias("u"), down.alias("d"))
    return ranked.select(group, _c(key).alias("a"), _c("u").alias("k")).join(ranked.select(group, _c(key).alias("b"), _c("d").alias("k")), [group, "k"]).select(group, "a", "b")


def resize_back(cut: DataFrame, keys: list[str], window, border, to, order: int = 1) -> DataFrame:
    """AG78: a window without its border, edge-padded again, zoomed to the source's shape."""
    from .volume import unpad, zoom

    inner = unpad(cut, window, border)
    size = tuple(w - 2 * b if b and 2 * b < w else w for w, b in zip(window, border, strict=True))
    return zoom(pad(inner, keys, size, tuple((w - s) // 2 for w, s in zip(window, size, strict=True)), "edge"), keys, window, to, order)


def transformed_centre(point: list[Column], shape: list[Column], source: str, target: str, pixdim, to) -> list[Column]:
    """WS18 for columns: a centre through reorientation and resampling, cut to integers."""
    from .volume import orientation

    moved = [(shape[i] - point[i] if d < 0 else point[i], pixdim[i]) for i, d in orientation(source, target)]
    return [(p.cast("double") * F.lit(float(a)) / F.lit(float(b))).cast("int") for (p, a), b in zip(moved, to, strict=True)]


def transform_centre(point: tuple[int, int, int], shape, source: str, target: str, pixdim, to) -> list[int]:
    """WS18: a centre through reorientation and resampling, on the driver."""
    from .volume import orientation

    moved = [(shape[i] - point[i] if d < 0 else point[i], pixdim[i]) for i, d in orientation(source, target)]
    return [int(math.trunc(p * a / b)) for (p, a), b in zip(moved, to, strict=True)]
