"""Borders, distances, connected components and error maps (AG23-AG29, AG44-AG53, AG69, J11-J13, F-A20, SE3)."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut
from .links import roots
from .quantiles import cumulated_few, linear
from .volume import AXES

_c = F.col
_STEPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def _neighbours(mask: DataFrame, steps) -> DataFrame:
    moved = F.array(*[F.struct(*[(_c(a) + d).alias(a) for a, d in zip(AXES, s, strict=True)]) for s in steps])
    return mask.select(*[c for c in mask.columns if c not in AXES], F.explode(moved).alias("__n")).select(*[c for c in mask.columns if c not in AXES], *[_c("__n")[a].alias(a) for a in AXES])


def border(mask: DataFrame, keys: list[str]) -> DataFrame:
    """AG23: voxels of a mask (keys, x, y, z) with fewer than six face neighbours in it; edge voxels are border.

    Each voxel credits its neighbours, one join and one aggregate; the mask alone is shuffled.
    """
    at = [*keys, *AXES]
    near = _neighbours(mask.select(*at), _STEPS).join(mask.select(*at), at, "left_semi").groupBy(*at).agg(F.count("*").alias("__n"))
    return mask.select(*at).join(near, at, "left").where(F.coalesce("__n", F.lit(0)) < 6).select(*at)


def border_distances(a: DataFrame, b: DataFrame, keys: list[str], pixdim: tuple[float, float, float] = (1.0, 1.0, 1.0), cell: int = 8) -> DataFrame:
    """AG24: for every border voxel of a, the distance to the nearest of b in the same group (none: no row).

    Voxels are dealt to cells of cell^3. Boxes around the voxels of two cells bound all their distances from below and
    above, so a cell of a keeps only cells of b that can hold a nearest voxel; voxels are paired inside these. Pairs of
    boxes are fewer than pairs of voxels by the fourth power of the cell size, and distances are exact.
    """
    def dealt(df: DataFrame, p: str) -> DataFrame:
        return df.select(*keys, *[F.floor(_c(x) / cell).cast("int").alias(f"__{p}c{x}") for x in AXES], *[_c(x).alias(f"__{p}{x}") for x in AXES])

    cells = {p: [f"__{p}c{x}" for x in AXES] for p in "ab"}
    voxels = {"a": dealt(a, "a"), "b": dealt(b, "b")}
    boxes = {p: v.groupBy(*keys, *cells[p]).agg(*[f(f"__{p}{x}").alias(f"__{p}{n}{x}") for x in AXES for n, f in (("lo", F.min), ("hi", F.max))]) for p, v in voxels.items()}
    square = lambda of: sum((F.pow(of(x) * p, 2) for x, p in zip(AXES, pixdim, strict=True)), F.lit(0.0))
    least = square(lambda x: F.greatest(_c(f"__blo{x}") - _c(f"__ahi{x}"), _c(f"__alo{x}") - _c(f"__bhi{x}"), F.lit(0)))
    most = square(lambda x: F.greatest(_c(f"__bhi{x}") - _c(f"__alo{x}"), _c(f"__ahi{x}") - _c(f"__blo{x}")))
    pairs = boxes["a"].join(boxes["b"], keys).select(*keys, *cells["a"], *cells["b"], least.alias("__least"), most.alias("__most"))
    bound = F.min("__most").over(Window.partitionBy(*keys, *cells["a"]))
    near = pairs.withColumn("__bound", bound).where("__least <= __bound").select(*keys, *cells["a"], *cells["b"])
    joined = voxels["a"].join(near, [*keys, *cells["a"]]).join(voxels["b"], [*keys, *cells["b"]])
    nearest = joined.groupBy(*keys, *[f"__a{x}" for x in AXES]).agg(F.sqrt(F.min(square(lambda x: _c(f"__a{x}") - _c(f"__b{x}")))).alias("distance"))
    return nearest.select(*keys, *[_c(f"__a{x}").alias(x) for x in AXES], "distance")


def _envelope(places: list[int], values: list[float], weight: float, low: int, high: int) -> list[float]:
    """The least of values[i] + weight * (p - places[i]) ** 2 for p = low .. high: the lower envelope of parabolas.

    places ascend. One pass drops parabolas that are nowhere lowest, one reads the others off; both are linear.
    """
    held: list[int] = []
    begins: list[float] = []
    for i, (at, value) in enumerate(zip(places, values, strict=True)):
        begin = -float("inf")
        while held:
            j = held[-1]
            begin = (value - values[j] + weight * (at * at - places[j] * places[j])) / (2 * weight * (at - places[j]))
            if begin > begins[-1]:
                break
            held.pop()
            begins.pop()
            begin = -float("inf")
        held.append(i)
        begins.append(begin)
    out, k = [], 0
    for p in range(low, high + 1):
        while k + 1 < len(held) and begins[k + 1] < p:
            k += 1
        out.append(values[held[k]] + weight * (p - places[held[k]]) ** 2)
    return out


def squared_field(points: DataFrame, bounds: DataFrame, keys: list[str], pixdim: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """AG24: (keys, x, y, z, value): the squared distance to the nearest point of the group, for all places in its bounds.

    bounds: keys and lo, hi of each axis (lox, hix, ...). The transform is separable: three passes, each over the lines of
    one axis, a group being one line. Work is linear in the places, whatever the number of points.
    """
    ends = [f"{n}{a}" for a in AXES for n in ("lo", "hi")]
    rows = points.select(*keys, *AXES).distinct().withColumn("value", F.lit(0.0)).join(bounds.select(*keys, *ends), keys)
    for axis, size in zip(AXES, pixdim, strict=True):
        others = [a for a in AXES if a != axis]
        cells = F.array_sort(F.collect_list(F.struct(_c(axis).alias("at"), "value")))
        lines = rows.groupBy(*keys, *ends, *others).agg(cells.alias("cells")).select(*keys, *ends, *others, _c("cells.at").alias("at"), _c("cells.value").alias("values"))
        kept = [*keys, *ends, *others]

        def lowest(batches, axis=axis, weight=float(size) ** 2, kept=kept):
            for pdf in batches:
                columns = (pdf["at"], pdf["values"], pdf[f"lo{axis}"].tolist(), pdf[f"hi{axis}"].tolist())
                out = [_envelope(p.tolist(), v.tolist(), weight, lo, hi) for p, v, lo, hi in zip(*columns, strict=True)]
                yield pdf[kept].assign(out=out)

        schema = T.StructType([*lines.select(*kept).schema, T.StructField("out", T.ArrayType(T.DoubleType()))])
        read = lines.mapInPandas(lowest, schema).select(*kept, F.posexplode("out").alias("place", "value"))
        rows = read.select(*keys, *ends, *others, (_c("place") + _c(f"lo{axis}")).cast("int").alias(axis), "value")
    return rows.select(*keys, *AXES, "value")


def field_distances(a: DataFrame, b: DataFrame, keys: list[str], pixdim: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """AG24: for every voxel of a, the distance to the nearest of b in the same group (none: no row), read off b's field."""
    bounds = a.groupBy(*keys).agg(*[f(x).alias(f"{n}{x}") for x in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    met = a.select(*keys, *AXES).join(squared_field(b, bounds, keys, pixdim), [*keys, *AXES])
    return met.select(*keys, *AXES, F.sqrt("value").alias("distance"))


def surface_distances(seg: DataFrame, ref: DataFrame, keys: list[str], pixdim=(1.0, 1.0, 1.0)) -> DataFrame:
    """AG25-AG27: average_distance, hausdorff_distance, hausdorff95_distance by group; groups with an empty side have none.

    Both sides are one table with a side column, so that borders and the distances of both directions are one plan each.
    """
    at, side = [*keys, *AXES], _c("__side")
    sides = seg.select(*at, F.lit(0).alias("__side")).unionByName(ref.select(*at, F.lit(1).alias("__side")))
    edges = border(sides, [*keys, "__side"])
    distances = field_distances(edges, edges.withColumn("__side", 1 - side), [*keys, "__side"], pixdim)
    # squared distances are sums of three squares, so a side has few different ones
    counts = cumulated_few(distances, [*keys, "__side"], _c("distance"))
    by_side = counts.groupBy(*keys, "__side").agg(F.sum(_c("v") * _c("n")).alias("s"), F.max("v").alias("m"), linear(0.95).alias("q"))
    union = edges.select(*at).distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    both = by_side.groupBy(*keys).agg(F.sum("s").alias("s"), F.max("m").alias("hausdorff_distance"), F.max("q").alias("hausdorff95_distance")).join(union, keys)
    return both.select(*keys, (_c("s") / _c("n")).alias("average_distance"), "hausdorff_distance", "hausdorff95_distance")


def _labels(group: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Face-connected components of the voxels of many groups (numbered from 0), numbered from 1 in each by their first voxel
    in C order."""
    order = np.lexsort((z, y, x, group))
    g, p = group[order].astype(np.int64), np.stack([x, y, z], axis=1)[order].astype(np.int64)
    low, span = p.min(axis=0), p.max(axis=0) - p.min(axis=0) + 3
    code = ((g * span[0] + p[:, 0] - low[0] + 1) * span[1] + p[:, 1] - low[1] + 1) * span[2] + p[:, 2] - low[2] + 1
    label = np.arange(len(p))
    pairs = []
    for step in (span[1] * span[2], span[2], 1):
        at = np.searchsorted(code, code + step)
        hit = np.flatnonzero((at < len(code)) & (code[np.minimum(at, len(code) - 1)] == code + step))
        pairs.append((hit, at[hit]))
    while True:
        before = label.copy()
        for i, j in pairs:
            low_ = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low_)
            np.minimum.at(label, j, low_)
        label = label[label]
        if (label == before).all():
            break
    number = np.unique(label, return_inverse=True)[1]
    out = np.empty(len(p), np.int64)
    # the first voxel of a group has its first component
    out[order] = number - number[np.searchsorted(g, g)] + 1
    return out


def _labelled(rows: DataFrame, groups: list[str], tile: int) -> DataFrame:
    """rows with the component of each voxel inside its group, which is one task's. Groups are sorted and come in batches of
    many; of a group that a batch ends in, the rows wait for the next one. A group lies in one tile."""
    schema = T.StructType([*rows.schema, T.StructField("component", T.IntegerType())])

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for k in groups:
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    def done(table: pa.Table, group: np.ndarray):
        found = _labels(group, *(table.column(a).to_numpy() % tile for a in AXES)).astype(np.int32)
        return table.append_column("component", pa.array(found)).to_batches()

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            table = pa.Table.from_batches(waiting).combine_chunks()
            group = numbered(table)
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield from done(table.slice(0, whole).combine_chunks(), group[:whole])
                waiting = table.slice(whole).combine_chunks().to_batches()
        if waiting:
            table = pa.Table.from_batches(waiting).combine_chunks()
            yield from done(table, numbered(table))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *groups).sortWithinPartitions(*groups).mapInArrow(run, schema)


#: Voxels of a tile along each axis, and the bits of a tile's place on an axis and of a label in it.
TILE, _PLACE_BITS, _LABEL_BITS = 64, 15, 18


def components(mask: DataFrame, keys: list[str], tile: int = TILE, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """AG28: mask voxels with `component` 1, 2, ... (face connectivity, numbered by first voxel in C order).

    Volumes are labelled tile by tile, each tile of at most tile^3 voxels in one task; labels that touch across a face
    of two tiles are linked, and linked labels get one root by distributed star steps. Where all voxels lie in the first
    tile, its labels are the result; a shape that says so spares the look at all coordinates. Coordinates are not
    negative and below tile * 2^15.
    """
    if shape and max(shape) <= tile:
        return _labelled(mask.select(*keys, *AXES), keys, tile)
    tiles = [f"__t{a}" for a in AXES]
    rows = mask.select(*keys, *AXES, *[F.floor(_c(a) / tile).cast("int").alias(t) for a, t in zip(AXES, tiles, strict=True)])
    one = _labelled(rows, [*keys, *tiles], tile)
    if rows.where(F.greatest(*tiles) > 0).isEmpty():
        return one.select(*keys, *AXES, "component")
    place = F.lit(0).cast("long")
    for t in tiles:
        place = place * 2**_PLACE_BITS + _c(t)
    labelled = cut(one.select(*keys, *AXES, (place * 2**_LABEL_BITS + _c("component")).alias("node")))
    linked = None
    for a in AXES:
        low = labelled.where(_c(a) % tile == tile - 1).select(*keys, *[(_c(x) + 1 if x == a else _c(x)).alias(x) for x in AXES], _c("node").alias("u"))
        high = labelled.where(_c(a) % tile == 0).select(*keys, *AXES, _c("node").alias("v"))
        met = low.join(high, [*keys, *AXES]).select(*keys, "u", "v").distinct()
        linked = met if linked is None else linked.unionByName(met)
    nodes = labelled.groupBy(*keys, "node").agg(F.min(F.struct(*AXES)).alias("__first")).join(roots(linked, keys), [*keys, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("__first"))
    numbers = nodes.groupBy(*keys, "root").agg(F.min("__first").alias("__first")).select(*keys, "root", number.alias("component"))
    named = nodes.select(*keys, "node", "root").join(numbers, [*keys, "root"]).select(*keys, "node", "component")
    return labelled.join(named, [*keys, "node"]).select(*keys, *AXES, "component")


def component_sizes(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """AG69: voxels with the size of their component."""
    sizes = labelled.groupBy(*keys, "component").agg(F.count("*").alias("size"))
    return labelled.join(sizes, [*keys, "component"])


def overlaps(seg: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """Every reference component with the sorted set of inferred components on its voxels (empty: none)."""
    s = seg.select(*keys, *AXES, _c("component").alias("seg_id"))
    joined = ref.select(*keys, *AXES, _c("component").alias("ref_id")).join(s, [*keys, *AXES], "left")
    return joined.groupBy(*keys, "ref_id").agg(F.array_sort(F.collect_set("seg_id")).alias("seg_ids"))


def component_metrics(seg: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """AG29: cc_id r<ref>_s<seg&seg>, and tp, fp, fn of each reference component against the union of those it meets."""
    pairs = overlaps(seg, ref, keys)
    sizes = ref.groupBy(*keys, _c("component").alias("ref_id")).agg(F.count("*").alias("n_ref"))
    met = pairs.select(*keys, "ref_id", F.explode("seg_ids").alias("seg_id"))
    s = seg.groupBy(*keys, _c("component").alias("seg_id")).agg(F.count("*").alias("n"))
    n_seg = met.join(s, [*keys, "seg_id"]).groupBy(*keys, "ref_id").agg(F.sum("n").alias("n_seg"))
    hit = ref.select(*keys, *AXES, _c("component").alias("ref_id")).join(seg.select(*keys, *AXES), [*keys, *AXES]).groupBy(*keys, "ref_id").agg(F.count("*").alias("tp"))
    rows = pairs.join(sizes, [*keys, "ref_id"]).join(n_seg, [*keys, "ref_id"], "left").join(hit, [*keys, "ref_id"], "left").na.fill(0, ["n_seg", "tp"])
    name = F.concat(F.lit("r"), _c("ref_id").cast("string"), F.lit("_s"), F.array_join(F.transform("seg_ids", lambda x: x.cast("string")), "&"))
    return rows.select(*keys, name.alias("cc_id"), "tp", (_c("n_seg") - _c("tp")).alias("fp"), (_c("n_ref") - _c("tp")).alias("fn"))


def error_maps(seg: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """AG45, AG48, SE3: every voxel in a component, with tpc, fnc, fpc (0 or 1): whether it is in a component that meets
    the other side, or in a missed reference or false inferred one."""
    r, s = ref.select(*keys, *AXES, _c("component").alias("r")), seg.select(*keys, *AXES, _c("component").alias("s"))
    both = r.join(s, [*keys, *AXES])
    good_r, good_s = both.select(*keys, "r").distinct().withColumn("gr", F.lit(1)), both.select(*keys, "s").distinct().withColumn("gs", F.lit(1))
    rows = r.join(s, [*keys, *AXES], "full").join(good_r, [*keys, "r"], "left").join(good_s, [*keys, "s"], "left")
    flag = lambda c, name: c.cast("int").alias(name)
    return rows.select(
        *keys, *AXES, _c("r").isNotNull().alias("in_ref"), _c("s").isNotNull().alias("in_seg"),
        flag(F.coalesce(_c("gr"), _c("gs"), F.lit(0)), "tpc"), flag(_c("r").isNotNull() & _c("gr").isNull(), "fnc"), flag(_c("s").isNotNull() & _c("gs").isNull(), "fpc"),
    )


def component_errors(seg: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """AG44, AG46, AG47: component counts, outline error (ratio, fp, fn voxels) and detection error by group."""
    maps = error_maps(seg, ref, keys)
    n = lambda c, name: F.count_if(c).cast("long").alias(name)
    on = (_c("tpc") == 1) & _c("in_seg")
    sums = maps.groupBy(*keys).agg(
        n(~_c("in_ref") & on, "oefp"), n(_c("in_ref") & ~on, "oefn"), n(_c("in_ref"), "__r"), n(_c("in_seg"), "__s"), F.sum("fpc").alias("defp"), F.sum("fnc").alias("defn"),
    )
    r, s = ref.select(*keys, *AXES, _c("component").alias("r")), seg.select(*keys, *AXES, _c("component").alias("s"))
    both = r.join(s, [*keys, *AXES])
    count = lambda df, c, name: df.select(*keys, c).distinct().groupBy(*keys).agg(F.count("*").alias(name))
    counts = [count(both, "r", "tp_components"), count(r, "r", "__nr"), count(s, "s", "__ns"), count(both, "s", "__ts")]
    for t in counts:
        sums = sums.join(t, keys, "left")
    sums = sums.na.fill(0)
    return sums.select(
        *keys, "tp_components", (_c("__ns") - _c("__ts")).alias("fp_components"), (_c("__nr") - _c("tp_components")).alias("fn_components"),
        F.try_divide(2 * (_c("oefn") + _c("oefp")), _c("__r") + _c("__s")).alias("oer"), "oefp", "oefn", (_c("defp") + _c("defn")).alias("de"), "defp", "defn",
    )


def region_shape(prob: DataFrame, keys: list[str], voxel: float = 1.0, threshold: float = 0.0) -> DataFrame:
    """AG49-AG53: volumes, surfaces, surface to volume, compactness and centre of the region p > 0 (centre: p > threshold).

    prob: keys, x, y, z, value. vol_prob and surf_prob sum p; vol and surf count voxels; both times the voxel volume.
    """
    inside = prob.where("value > 0")
    edge = border(inside, keys).withColumn("__b", F.lit(1))
    rows = inside.join(edge, [*keys, *AXES], "left")
    v, b = _c("value"), _c("__b") == 1
    out = rows.groupBy(*keys).agg(
        (F.sum(v) * voxel).alias("vol_prob"), (F.count("*") * voxel).alias("vol"), (F.coalesce(F.sum(F.when(b, v)), F.lit(0.0)) * voxel).alias("surf_prob"), (F.count_if(b) * voxel).alias("surf"),
        *[F.avg(F.when(v > threshold, _c(a))).alias(f"centre_{a}") for a in AXES],
    )
    return out.select("*", F.try_divide(_c("surf"), _c("vol")).alias("sav"), F.try_divide(F.pow(_c("surf"), 1.5), _c("vol")).alias("compactness"))


def dilated(mask: DataFrame, keys: list[str], shape: tuple[int, int, int], times: int = 1) -> DataFrame:
    """F-A20: the mask grown by face neighbours inside the volume."""
    at = [*keys, *AXES]
    for _ in range(times):
        near = _neighbours(mask.select(*at), _STEPS)
        for a, n in zip(AXES, shape, strict=True):
            near = near.where(_c(a).between(0, n - 1))
        mask = mask.select(*at).unionByName(near.select(*at)).distinct()
    return mask


def filled(mask: DataFrame, spine: DataFrame, keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """F-A20: the mask with its holes: background components that touch no face of the volume."""
    at = [*keys, *AXES]
    ground = components(spine.select(*at).join(mask.select(*at), at, "left_anti"), keys, shape=shape)
    edge: Column = F.lit(False)
    for a, n in zip(AXES, shape, strict=True):
        edge = edge | (_c(a) == 0) | (_c(a) == n - 1)
    outer = ground.where(edge).select(*keys, "component").distinct()
    return mask.select(*at).unionByName(ground.join(outer, [*keys, "component"], "left_anti").select(*at))


def label_spine(subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """Subjects x distinct labels: the labels, one row with their set after a map-side aggregate, are broadcast."""
    name = labels.columns[0]
    classes = labels.agg(F.array_sort(F.collect_set(name)).alias("__labels"))
    return subjects.join(F.broadcast(classes), F.lit(True)).withColumn(name, F.explode("__labels")).drop("__labels")


#: Shifts of the co-occurrence neighbourhood: the centre, the six face neighbours, then all other 20 neighbours in the
#: order of product(). Features are averaged over shifts, so that order does not matter for whole neighbourhoods.
SHIFTS = [(0, 0, 0), *_STEPS, *[s for s in product((-1, 0, 1), repeat=3) if sum(map(abs, s)) > 1]]
