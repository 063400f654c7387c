"""Runs from a configuration: evaluation, inference and training windows (U2, U9-U12, U14, J13, AG73; survey 3.1-3.3).

A run is a PipelineSpec and tables. Its plan is lazy: reading, windows, the prediction, reassembly and metrics are one
DataFrame each, and nothing is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import confusion as M
from ..operators import intensity as I
from ..operators import surface as B
from ..operators import volume as V
from ..operators import windows as W
from ..operators.catalog import SUBJECT
from ..sources import files, images
from ..sources.shared import cut, qualified
from . import chain
from .evaluation import DEFAULTS, evaluate_segmentation, merge_frames
from .layers import Registry
from .spec import PipelineSpec, SourceSpec, look_up

#: Samplers by name, (voxels, images, key, window, samples) -> windows (key, draw, x0 .. z1).
SAMPLERS = Registry("sampler")
#: Metrics by name, (voxels, keys, **frames that it needs) -> frame of the keys and one or more columns.
METRICS = Registry("metric")
#: Sub-analyses by name, (voxels, keys) -> frame; a run makes each of those that its metrics need once.
ANALYSES = Registry("analysis")
#: Centre generators by name, (voxels, images, key, window, samples) -> centres (key, draw, x, y, z).
CENTRES = Registry("centre generator")
#: Keys beside the subject: time points and modalities.
CHANNELS = ("t", "m")
#: Applications by name.
APPLICATIONS = Registry("application")


def _around(centres: DataFrame, key: str, window) -> DataFrame:
    starts = centres.select(key, "draw", *[(F.col(a) - w // 2).cast("int").alias(f"{a}0") for a, w in zip(V.AXES, window, strict=True)])
    return starts.select("*", *[(F.col(f"{a}0") + w).alias(f"{a}1") for a, w in zip(V.AXES, window, strict=True)])


@SAMPLERS.register("uniform")
def uniform(vox, sizes, key, window, samples, shape=None):
    return W.uniform_windows(sizes, key, window, samples)


@SAMPLERS.register("weighted")
def weighted(vox, sizes, key, window, samples, shape=None):
    return _around(W.weighted_centres(vox, [key], shape, window, samples), key, window)


@SAMPLERS.register("balanced")
def balanced(vox, sizes, key, window, samples, shape=None):
    return _around(W.balanced_centres(vox, [key], shape, window, samples), key, window)


@SAMPLERS.register("grid")
def grid(vox, sizes, key, window, samples, shape=None):
    return W.grid_windows(sizes, key, window).withColumnRenamed("seq", "draw")


@SAMPLERS.register("resize")
def resize(vox, sizes, key, window, samples, shape=None):
    return W.whole_image(sizes, key).withColumn("draw", F.lit(0))


def needs(*names: str):
    """Marks a metric with the sub-analyses that it takes as keyword arguments."""

    def mark(f):
        f.needs = names
        return f

    return mark


@ANALYSES.register("confusion")
def confusion_counts(vox, keys):
    """(keys, tp, fp, fn, tn) of the foregrounds."""
    return M.confusion(vox, keys, F.col("inferred") != 0, F.col("reference") != 0)


@ANALYSES.register("borders")
def borders(vox, keys):
    """(keys, side, x, y, z): border voxels of the inferred (side 0) and the reference foreground (side 1)."""
    at = [*keys, *V.AXES]
    sides = [vox.where(F.col(c) != 0).select(*at, F.lit(i).alias("side")) for i, c in enumerate(("inferred", "reference"))]
    return B.border(sides[0].unionByName(sides[1]), [*keys, "side"])


@ANALYSES.register("border_distances")
@needs("borders")
def border_distances(vox, keys, borders):
    """(keys, side, x, y, z, distance): of each border voxel to the other side's border."""
    return B.field_distances(borders, borders.withColumn("side", 1 - F.col("side")), [*keys, "side"])


class Shared:
    """The sub-analyses of one evaluation: each is made when it is first asked for, written once, and shared."""

    def __init__(self, vox: DataFrame, keys: list[str]):
        self.vox, self.keys, self.made = vox, keys, {}

    def frame(self, name: str) -> DataFrame:
        if name not in self.made:
            f = ANALYSES.get(name)
            self.made[name] = cut(f(self.vox, self.keys, **self.frames(f)))
        return self.made[name]

    def frames(self, f) -> dict[str, DataFrame]:
        return {n: self.frame(n) for n in getattr(f, "needs", ())}


def windows_around(centres: DataFrame, images: DataFrame, key: str, window: tuple[int, int, int]) -> DataFrame:
    """U12, WS5: windows around centres, moved to where they fit; one that is larger than its image begins at 0 and is padded
    when it is cut. A centre outside its image counts as the nearest place inside."""
    sizes = images.select(key, *[F.col(a.upper()).alias(n) for a, n in zip(V.AXES, V.SIZES, strict=True)])
    rows = centres.select(key, "draw", *V.AXES).join(sizes, key)
    at = [F.least(F.greatest(F.col(a), F.lit(0)), F.col(n) - 1) for a, n in zip(V.AXES, V.SIZES, strict=True)]
    starts = [F.greatest(F.lit(0), F.least(c - w // 2, F.col(n) - w)).cast("int").alias(f"{a}0") for a, n, c, w in zip(V.AXES, V.SIZES, at, window, strict=True)]
    return rows.select(key, "draw", *starts).select("*", *[(F.col(f"{a}0") + w).alias(f"{a}1") for a, w in zip(V.AXES, window, strict=True)])


def voxel_table(packed: DataFrame, key: str) -> DataFrame:
    """The voxel view (key, t, m, nx, ny, nz, x, y, z, value) of packed volumes of rank 2 to 6, each with its own shape."""
    rows = packed.select(key, V.expanded_shape(F.col("shape")).alias("s"), F.posexplode("voxels").alias("pos", "v"))
    at, place = F.col("pos"), {}
    for i, a in reversed(list(enumerate((*V.AXES, "t", "m")))):
        n = F.get("s", F.lit(i))
        place[a] = (at % n).cast("int")
        at = F.floor(at / n)
    sizes = [F.get("s", F.lit(i)).cast("int").alias(n) for i, n in enumerate(V.SIZES)]
    return rows.select(key, *[place[a].alias(a) for a in CHANNELS], *sizes, *[place[a].alias(a) for a in V.AXES], F.col("v").cast("double").alias("value"))


def voxels_of(packed: DataFrame, key: str) -> DataFrame:
    """The voxel view (key, x, y, z, value) of packed volumes of one time point and one modality; others are an error."""
    one = F.when((F.col("t") == 0) & (F.col("m") == 0), F.col("value")).otherwise(F.raise_error(F.lit("a volume with several time points or modalities: see voxel_table")).cast("double"))
    return voxel_table(packed, key).select(key, *V.AXES, one.alias("value"))


def packed_volumes(vox: DataFrame, key: str) -> DataFrame:
    """(key, shape, voxels) of a view with t, m and sizes: shape (x, y, z, t, m), voxels in C order."""
    order = (*V.AXES, *CHANNELS)
    rows = F.array_sort(F.collect_list(F.struct(*order, "value")))
    held = vox.groupBy(key, *V.SIZES).agg((F.max("t") + 1).alias("nt"), (F.max("m") + 1).alias("nm"), rows.alias("rows"))
    return held.select(key, F.array(*V.SIZES, "nt", "nm").alias("shape"), F.transform("rows", lambda r: r["value"].cast("float")).alias("voxels"))


def listed_files(spark: SparkSession, source: SourceSpec, name: str) -> DataFrame:
    """(subject_id, file) of a section, from its CSV or by search; file is the whole path, as Spark's readers name it.

    The folders of a CSV's paths go through the driver, as a reader's list of folders does.
    """
    if source.csv_file:
        split = files.read_section(spark, source.csv_file, "path").select(SUBJECT, F.trim(F.regexp_extract("path", r"^(.*?)[^/]*$", 1)).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("base"))
        folders = [r.folder for r in split.select("folder").distinct().collect()]
        names = spark.createDataFrame([(f, qualified(spark, f or ".")) for f in folders], "folder string, whole string")
        return split.join(names, "folder").select(SUBJECT, F.concat_ws("/", F.regexp_replace("whole", "/$", ""), "base").alias("file"))
    if source.path_to_search:
        searched = [p.strip() for p in source.path_to_search.split(",") if p.strip()]
        found = files.scan_directory(spark, searched, list(source.filename_contains), list(source.filename_not_contains), source.filename_removefromid or None)
        return found.select(SUBJECT, F.col("path").alias("file"))
    raise ValueError(f"{name}: neither csv_file nor path_to_search")


def load_packed(spark: SparkSession, source: SourceSpec, name: str) -> DataFrame:
    """A section's files as packed volumes (subject_id, path, shape, affine, pixdim, voxels): the listed paths themselves, in
    any number of folders; a listed file that is not there is an error. Files that are not listed are not decoded.

    Tasks open the paths that they are dealt. Only where pyarrow does not reach a folder is it listed by Spark's reader, and
    its list of files held by the driver.
    """
    named = listed_files(spark, source, name).withColumnRenamed("file", "path")
    folders = [r.folder for r in named.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct().collect()]
    by_tasks = all(images.reached(f) for f in folders)
    there = None if by_tasks else spark.read.format("binaryFile").load(folders)
    gone = images.absent(named) if by_tasks else named.join(there.select("path"), "path", "left_anti")
    absent = gone.limit(3).collect()
    if absent:
        raise FileNotFoundError(f"{name}: " + ", ".join(r.path for r in absent))
    if by_tasks:
        return images.opened(named.select(SUBJECT, "path"), source.loader)
    read = there.select("path", "content").join(named.select("path").distinct(), "path", "left_semi")
    return images.decoded(read, source.loader).join(named, "path")


def load_source(spark: SparkSession, source: SourceSpec, name: str) -> DataFrame:
    """A section's volumes as voxels (subject_id, t, m, nx, ny, nz, x, y, z, value), each with its own shape."""
    return voxel_table(load_packed(spark, source, name), SUBJECT)


def aligned_voxels(inferred: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Predictions and labels side by side, by subject and voxel: (key, x, y, z, inferred, reference).

    Where both sides carry t and m, these tell voxels apart; where both carry sizes, different ones are an error. Subjects
    of one side only are left out.
    """
    both = [c for c in (*CHANNELS, *V.SIZES) if c in inferred.columns and c in reference.columns]
    at = [key, *[c for c in CHANNELS if c in both], *V.AXES]
    sizes = [c for c in V.SIZES if c in both]
    left = inferred.select(*at, F.col("value").alias("inferred"), *[F.col(c).alias(f"__i{c}") for c in sizes])
    right = reference.select(*at, F.col("value").alias("reference"), *[F.col(c).alias(f"__r{c}") for c in sizes])
    rows = left.join(right, at)
    if sizes:
        same = F.lit(True)
        for c in sizes:
            same = same & (F.col(f"__i{c}") == F.col(f"__r{c}"))
        error = F.raise_error(F.concat(F.lit("shapes differ: "), F.col(key).cast("string")))
        rows = rows.withColumn("inferred", F.when(same, F.col("inferred")).otherwise(error.cast("double")))
    return rows.select(*at, "inferred", "reference")


class Application:
    """What a run does at each of its ends; subclasses name their section and evaluate aligned voxels."""

    section = ""

    def __init__(self, spec: PipelineSpec, key: str = SUBJECT):
        self.spec, self.key = spec, key

    def names(self) -> tuple[str, ...]:
        return self.spec.sections["EVALUATION"].evaluations or DEFAULTS[self.section]

    def evaluate(self, vox: DataFrame) -> dict[tuple[str, ...], DataFrame]:
        raise NotImplementedError

    def custom(self, vox: DataFrame, keys: list[str]) -> list[DataFrame]:
        """Frames of the registered metrics among the names."""
        shared = Shared(vox, keys)
        return [METRICS.create(n, vox, keys, **shared.frames(METRICS.get(n))) for n in self.names() if n in METRICS.names()]


@APPLICATIONS.register("segmentation")
class Segmentation(Application):
    section = "segmentation"

    def evaluate(self, vox: DataFrame) -> dict[tuple[str, ...], DataFrame]:
        own = METRICS.names()
        plain = tuple(n for n in self.names() if n not in own)
        out: dict[tuple[str, ...], DataFrame] = {}
        for unit in self.spec.sections["SEGMENTATION"].evaluation_units.split(","):
            labels = list(range(max(0, self.spec.sections["SEGMENTATION"].num_classes))) if unit == "label" else None
            out |= evaluate_segmentation(vox, self.key, plain, unit, labels)
        more = self.custom(vox, [self.key])
        if more and (self.key,) in out:
            out[self.key,] = merge_frames([out[self.key,], *more], [self.key])
        return out


@APPLICATIONS.register("regression")
class Regression(Application):
    section = "regression"

    def evaluate(self, vox: DataFrame) -> dict[tuple[str, ...], DataFrame]:
        """Voxels by subject; every metric comes from one aggregate."""
        known = ["mse", "rmse", "mae", "r2"]
        wanted = [look_up(n, known) for n in self.names() if n not in METRICS.names()]
        frame = M.regression(vox, [self.key], F.col("inferred").cast("double"), F.col("reference").cast("double")).select(self.key, *wanted)
        return {(self.key,): merge_frames([frame, *self.custom(vox, [self.key])], [self.key])}


@APPLICATIONS.register("classification")
class Classification(Application):
    section = "classification"

    def evaluate(self, vox: DataFrame) -> dict[tuple[str, ...], DataFrame]:
        """One probability and one label a row: accuracy and roc_auc over all rows, and the roc table by threshold."""
        known = ["accuracy", "classification_accuracy", "roc_auc", "roc"]
        wanted = [look_up(n, known) for n in self.names() if n not in METRICS.names()]
        rows = vox.withColumn("__all", F.lit(1))
        p, y = F.col("inferred").cast("double"), F.col("reference") == 1
        frames = []
        if {"accuracy", "classification_accuracy"} & set(wanted):
            frames.append(M.accuracy(rows, ["__all"], (p >= 0.5).cast("int"), F.col("reference").cast("int")))
        if "roc_auc" in wanted:
            frames.append(M.roc_auc(rows, ["__all"], p, y).withColumnRenamed("auc", "roc_auc"))
        out: dict[tuple[str, ...], DataFrame] = {}
        if frames:
            out[()] = merge_frames(frames, ["__all"]).drop("__all")
        if "roc" in wanted:
            out["threshold",] = M.roc_table(rows, ["__all"], p, y).drop("__all")
        return out


def run_evaluation(spec: PipelineSpec, application: str, inferred: DataFrame, reference: DataFrame, key: str = SUBJECT) -> dict[tuple[str, ...], DataFrame]:
    """Survey 3.3: metric frames by grouping key, from the voxels of predictions and references."""
    return APPLICATIONS.create(application, spec, key).evaluate(aligned_voxels(inferred, reference, key))


def evaluate_files(spark: SparkSession, spec: PipelineSpec, application: str) -> list[str]:
    """Survey 3.3 from files to files: reads the sections `inferred` and `label`, writes eval_<keys>.csv to save_csv_dir."""
    inferred, reference = (load_source(spark, spec.sources[n], n) for n in ("inferred", "label"))
    frames = run_evaluation(spec, application, inferred, reference)
    return files.write_metrics(frames, spec.sections["EVALUATION"].save_csv_dir)


def prepared(spec: PipelineSpec, vox: DataFrame, key: str, shape=None) -> tuple[DataFrame, tuple]:
    """The preprocessing of a run: whitening (over the foreground, if so set), then padding; and the padded shape.

    shape: of all volumes; None where each carries its own in nx, ny, nz, which then are the padded ones afterwards.
    """
    net = spec.sections["NETWORK"]
    keys = [key, *[c for c in CHANNELS if c in vox.columns]]
    own = shape is None
    if own:
        keys, shape = V.sized(keys)
    if net.whitening:
        inside = None
        if net.normalise_foreground_only:
            vox, inside = I.foreground(vox, keys, "value", net.foreground_type), F.col("mask")
        vox = I.whitened(vox, keys, "value", inside).drop("value", "mask").withColumnRenamed("white", "value").select(*keys, *V.AXES, "value")
    border = _three(net.volume_padding_size)
    padded = V.pad(vox, keys, shape, border, net.volume_padding_mode)
    if own:
        return V.resized(padded, tuple(2 * b for b in border)), shape
    return padded, tuple(n + 2 * b for n, b in zip(shape, border, strict=True))


def _image_sizes(vox: DataFrame, key: str, grown) -> DataFrame:
    """(key, X, Y, Z) of each volume."""
    of = [c for c in V.SIZES if c in vox.columns]
    return vox.select(key, *of).distinct().select(key, *[F.lit(n).cast("int").alias(a.upper()) for a, n in zip(V.AXES, grown, strict=True)])


def _three(values: tuple[int, ...]) -> tuple[int, int, int]:
    return tuple([*values, *[values[-1] if len(values) == 1 else 0] * 3][:3]) if values else (0, 0, 0)


def run_inference(spec: PipelineSpec, vox: DataFrame, predict: Callable[[DataFrame], DataFrame], shape=None, key: str = SUBJECT) -> DataFrame:
    """Survey 3.2: the volumes that a window model makes: prepare, cut into grid windows, predict, crop, reassemble, unpad.

    predict: window voxels (key, t, m where there are any, seq, x0, y0, z0, x, y, z, value) -> the same columns, value
    replaced; it may give other t and m. shape: of all volumes; None where each carries its own in nx, ny, nz: the result
    then has them too, and every window size is to be given.
    """
    set_ = spec.sections["INFERENCE"]
    inside, grown = prepared(spec, vox, key, shape)
    own = shape is None
    if own and (len(set_.spatial_window_size) < 3 or min(set_.spatial_window_size) <= 0):
        raise ValueError("volumes of different shapes need a spatial_window_size of three positive numbers")
    window = tuple(set_.spatial_window_size[:3]) if own else tuple(W.window_sizes(list(set_.spatial_window_size), list(grown)))
    border, channels = _three(set_.border), tuple(c for c in CHANNELS if c in vox.columns)
    sizes = _image_sizes(inside, key, grown)
    cut = predict(W.cut_windows(inside, sizes, key, window, border, channels))
    spine = inside.select(key, *V.AXES).distinct() if channels else inside
    whole = W.assemble(W.crop_windows(cut, window, border), spine, key, set_.fill_constant, channels)
    edge = _three(spec.sections["NETWORK"].volume_padding_size)
    if not own:
        return V.unpad(whole, grown, edge)
    whole = whole.join(sizes.select(key, *[F.col(a.upper()).alias(n) for a, n in zip(V.AXES, V.SIZES, strict=True)]), key)
    kept = tuple(F.when(2 * F.lit(b) < F.col(n), -2 * b).otherwise(0) for n, b in zip(V.SIZES, edge, strict=True))
    return V.resized(V.unpad(whole, tuple(F.col(n) for n in V.SIZES), edge), kept).select(key, *channels, *V.SIZES, *V.AXES, "value")


def infer_files(spark: SparkSession, spec: PipelineSpec, predict: Callable[[DataFrame], DataFrame], name: str = "image") -> DataFrame:
    """Survey 3.2 from files to files: reads a section, infers, writes one NIfTI-1 file a subject to save_seg_dir, with the
    affine and voxel sizes of its source, and the manifest `inferred.csv`; returns the manifest (subject_id, path)."""
    set_ = spec.sections["INFERENCE"]
    read = cut(load_packed(spark, spec.sources[name], name))  # files are opened and decoded once, not once a use
    made = packed_volumes(run_inference(spec, voxel_table(read, SUBJECT), predict), SUBJECT)
    heads = read.select(SUBJECT, "affine", "pixdim")
    named = made.join(heads, SUBJECT).withColumn("path", F.concat(F.col(SUBJECT), F.lit(f"{set_.output_postfix}.nii")))
    written = images.write_files(images.nifti_bytes(named.select(SUBJECT, "path", "shape", "affine", "pixdim", "voxels")), set_.save_seg_dir)
    manifest = written.select(F.regexp_replace("name", re.escape(f"{set_.output_postfix}.nii") + "$", "").alias(SUBJECT), "path")
    files.write_manifest(manifest.withColumnRenamed("path", "file"), f"{set_.save_seg_dir.rstrip('/')}/inferred.csv")
    return manifest


def run_training_windows(spec: PipelineSpec, vox: DataFrame, window: tuple[int, int, int], shape=None, key: str = SUBJECT) -> DataFrame:
    """Survey 3.1: the voxels of the training windows that the sampler of a run draws: (key, t, m where there are any, draw,
    x, y, z, value). shape: of all volumes; None where each carries its own in nx, ny, nz.

    Windows are few a volume: each is exploded to its places, which meet the voxels by an equi-join. A sampler that
    weighs voxels sees those of the first time point and modality. window_sampling names a sampler or a centre generator.
    """
    inside, grown = prepared(spec, vox, key, shape)
    channels = [c for c in CHANNELS if c in vox.columns]
    seen = inside
    for c in channels:
        seen = seen.where(F.col(c) == 0)
    name, samples, images_ = spec.sections["NETWORK"].window_sampling, spec.sections["TRAINING"].sample_per_volume, _image_sizes(inside, key, grown)
    generated = name in CENTRES.names()
    drawn = windows_around(CENTRES.create(name, seen, images_, key, window, samples), images_, key, window) if generated else SAMPLERS.create(name, seen, images_, key, window, samples, shape=grown)
    places = drawn
    for a in V.AXES:
        places = places.withColumn(a, F.explode(F.sequence(F.col(f"{a}0"), F.col(f"{a}1") - 1)))
    if generated:  # windows may reach beyond a small image: such places are 0 in each of its channels
        if channels:
            places = places.join(inside.select(key, *channels).distinct(), key)
        met = places.join(inside, [key, *channels, *V.AXES], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    else:
        met = places.join(inside, [key, *V.AXES])
    return met.select(key, *channels, "draw", *[(F.col(a) - F.col(f"{a}0")).alias(a) for a in V.AXES], "value")


def volumes_of(packed: DataFrame, key: str) -> DataFrame:
    """(key, nx, ny, nz, affine, pixdim) of packed volumes."""
    five = V.expanded_shape(F.col("shape"))
    return packed.select(key, *[F.get(five, F.lit(i)).cast("int").alias(n) for i, n in enumerate(V.SIZES)], "affine", "pixdim")


def run_chain(spec: PipelineSpec, packed: DataFrame, section: str, key: str = SUBJECT, seed: int | None = None) -> DataFrame:
    """The volumes of a section as a run takes them: read at the section's axes and voxel sizes, normalised, augmented
    with a seed (training) or not (inference); each of its own shape. Windows of them come from run_training_windows or
    run_inference, which pad; these whiten too, so give them a spec without whitening then. Keys that are not applied are refused."""
    chain.refuse_unknown(spec)
    source = spec.sources[section]
    vox, _ = chain.as_read(voxel_table(packed, key), volumes_of(packed, key), source, key)
    vox = chain.normalised(spec, vox, key)
    if seed is not None:
        vox = chain.augmented(spec, vox, key, seed, source.interp_order)
    return vox


def source_of_step(schedule: DataFrame, sources: dict[str, DataFrame], index: str = "batch") -> DataFrame:
    """ST19: for steps (iteration, phase), the batch of the phase's source: the k-th step of a phase takes batch k modulo
    the number of its batches. Steps are numbered inside their phase without gathering them."""
    from ..operators.catalog import global_rank

    out = None
    for phase, rows in sources.items():
        steps = global_rank(schedule.where(F.col("phase") == phase).select("iteration", "phase"), [F.col("iteration")])
        n = rows.agg((F.max(index) + 1).alias("__n"))
        taken = steps.join(F.broadcast(n), F.lit(True)).select("iteration", "phase", ((F.col("rank") - 1) % F.col("__n")).alias(index)).join(rows, index)
        out = taken if out is None else out.unionByName(taken)
    return out
