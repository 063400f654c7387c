"""Evaluation runs: metric names to plans, units, roll-ups (AG31, AG32, AG73, AG74, J18, U1)."""

from __future__ import annotations

import importlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import confusion as M
from ..operators import surface as B
from .spec import look_up

DISTANCES = ("average_distance", "hausdorff_distance", "hausdorff95_distance")
DEFAULTS = {
    "segmentation": ("dice", "jaccard", "average_distance"),
    "classification": ("accuracy", "roc_auc", "roc"),
    "regression": ("mse", "rmse", "mae"),
}
UNITS = ("foreground", "label", "cc")


def select_module(name: str, table: dict):
    """An entry of a table by short key (a near miss is hinted at), or anything by dotted name."""
    if "." in name:
        module, _, attribute = name.rpartition(".")
        return getattr(importlib.import_module(module), attribute)
    return table[look_up(name, table)]


def merge_frames(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """J18, SE8: metric frames of one key in one frame: full join, the first non-null value of a column stays."""

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in b.columns if c in a.columns and c not in keys]
        joined = a.join(b.withColumnsRenamed({c: f"__{c}" for c in shared}), keys, "full")
        return joined.withColumns({c: F.coalesce(c, f"__{c}") for c in shared}).drop(*[f"__{c}" for c in shared])

    return reduce(both, frames)


def evaluate_segmentation(vox: DataFrame, subject: str, names: tuple[str, ...] = (), unit: str = "foreground", labels: list[int] | None = None) -> dict[tuple[str, ...], DataFrame]:
    """AG73: metric frames by grouping key, from voxels (subject, x, y, z, inferred, reference).

    foreground compares non-zero voxels, label each given label, cc each reference component of the foreground. All
    overlap metrics of a unit come from one aggregate; roll-ups (mean and stdev by label) exist for labels only.
    """
    look_up(unit, list(UNITS))
    names = names or DEFAULTS["segmentation"]
    if unit == "cc" and set(names) & set(DISTANCES):
        raise ValueError("components have no distances: ask for them with foreground or label")
    overlap = [n for n in names if n not in DISTANCES]
    for n in overlap:
        look_up(n, [*M.OVERLAP, *M.ALIASES, "tp", "fp", "fn", "tn"])
    seg, ref = F.col("inferred"), F.col("reference")
    if unit == "cc":
        at = [subject, "x", "y", "z"]
        s, r = B.components(vox.where(seg != 0).select(*at), [subject]), B.components(vox.where(ref != 0).select(*at), [subject])
        counts = B.component_metrics(s, r, [subject])
        size = vox.groupBy(subject).agg(F.count("*").alias("__n"))
        counts = counts.join(size, subject).withColumn("tn", F.col("__n") - F.col("tp") - F.col("fp") - F.col("fn")).drop("__n")
        return {(subject, "cc_id"): M.overlap_metrics(counts, [n for n in overlap if n not in ("tp", "fp", "fn", "tn")])}
    keys = [subject]
    rows = vox.withColumns({"inferred": seg != 0, "reference": ref != 0})
    if unit == "label":
        keys = [subject, "label"]
        rows = vox.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels]))).withColumns({"inferred": seg == F.col("label"), "reference": ref == F.col("label")})
    frames = [M.overlap_metrics(M.confusion(rows, keys, seg, ref), [n for n in overlap if n not in ("tp", "fp", "fn", "tn")])]
    wanted = [n for n in names if n in DISTANCES]
    if wanted:
        at = [*keys, "x", "y", "z"]
        frames.append(B.surface_distances(rows.where(seg).select(*at), rows.where(ref).select(*at), keys).select(*keys, *wanted))
    out = {tuple(keys): merge_frames(frames, keys)}
    if unit == "label":
        values = [n for n in names if n in out[tuple(keys)].columns]
        out["label",] = M.roll_up(out[tuple(keys)], ["label"], values)
    return out


def aggregate_frame(frame: DataFrame, by: list[str], functions: dict[str, object]) -> DataFrame:
    """AG31: a custom roll-up: output name -> aggregate Column, or a pandas function for applyInPandas."""
    return frame.groupBy(*by).agg(*[c.alias(n) for n, c in functions.items()])
