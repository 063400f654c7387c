"""Specifications of a run: sections, keys and defaults, with validation (PF4, PF14, PF15, PF17, 2.15)."""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass, fields, replace


def edit_distance(a: str, b: str) -> int:
    """F-S4 on the driver: insert, delete, replace and swap of neighbours."""
    d = {(-1, -1): 0} | {(i, -1): i + 1 for i in range(len(a))} | {(-1, j): j + 1 for j in range(len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def look_up(name: str, known: list[str] | dict) -> str:
    """PF14: the name where it is known, else an error that names what it could mean (distance up to 3)."""
    if name in known:
        return name
    near = sorted((edit_distance(name.lower(), k.lower()), edit_distance(name, k), k) for k in known)
    hint = f"; did you mean {near[0][2]}?" if near and near[0][0] <= 3 else ""
    raise ValueError(f"unknown: {name}{hint}")


@dataclass(frozen=True)
class SourceSpec:
    """An input section."""

    csv_file: str = ""
    csv_data_file: str = ""
    to_ohe: bool = False
    path_to_search: str = ""
    filename_contains: tuple[str, ...] = ()
    filename_not_contains: tuple[str, ...] = ()
    filename_removefromid: str = ""
    interp_order: int = 1
    loader: str | None = None
    pixdim: tuple[float, ...] = ()
    axcodes: tuple[str, ...] = ()
    spatial_window_size: tuple[int, ...] = ()

    @property
    def searched(self) -> bool:
        """PF17: sections with a data file are no part of the file search."""
        return not self.csv_data_file and not self.csv_file and bool(self.path_to_search)


@dataclass(frozen=True)
class SystemSpec:
    num_threads: int = 2
    model_dir: str = ""
    dataset_split_file: str = ""
    event_handler: tuple[str, ...] = ()
    iteration_generator: str = ""


@dataclass(frozen=True)
class DataSpec:
    batch_size: int = 2
    smaller_final_batch_mode: str = "pad"
    volume_padding_size: tuple[int, ...] = (0, 0, 0)
    volume_padding_mode: str = "minimum"
    volume_padding_to_size: tuple[int, ...] = (0,)
    window_sampling: str = "uniform"
    force_output_identity_resizing: bool = False
    queue_length: int = 5
    multimod_foreground_type: str = "and"
    histogram_ref_file: str = ""
    norm_type: str = "percentile"
    cutoff: tuple[float, ...] = (0.01, 0.99)
    foreground_type: str = "otsu_plus"
    normalisation: bool = False
    rgb_normalisation: bool = False
    whitening: bool = False
    normalise_foreground_only: bool = False


@dataclass(frozen=True)
class TrainingSpec:
    sample_per_volume: int = 1
    rotation_angle: tuple[float, ...] = ()
    rotation_angle_x: tuple[float, ...] = ()
    rotation_angle_y: tuple[float, ...] = ()
    rotation_angle_z: tuple[float, ...] = ()
    scaling_percentage: tuple[float, ...] = ()
    isotropic_scaling: bool = False
    antialiasing: bool = True
    bias_field_range: tuple[float, ...] = ()
    bf_order: int = 3
    random_flipping_axes: tuple[int, ...] = (-1,)
    do_elastic_deformation: bool = False
    num_ctrl_points: int = 4
    deformation_sigma: float = 15
    proportion_to_deform: float = 0.5
    exclude_fraction_for_validation: float = 0.0
    exclude_fraction_for_inference: float = 0.0
    lr: float = 0.01
    loss_type: str = "Dice"
    starting_iter: int = 0
    save_every_n: int = 500
    max_iter: int = 10000
    validation_every_n: int = -1
    validation_max_iter: int = 1
    patience: int = 100
    early_stopping_mode: str = "mean"


@dataclass(frozen=True)
class InferenceSpec:
    spatial_window_size: tuple[int, ...] = ()
    inference_iter: int = -1
    dataset_to_infer: str = ""
    save_seg_dir: str = ""
    output_postfix: str = "_out"
    output_interp_order: int = 0
    border: tuple[int, ...] = (0, 0, 0)
    fill_constant: float = 0.0


@dataclass(frozen=True)
class EvaluationSpec:
    evaluations: tuple[str, ...] = ()
    save_csv_dir: str = ""


@dataclass(frozen=True)
class SegmentationSpec:
    num_classes: int = -1
    output_prob: bool = False
    label_normalisation: bool = False
    softmax: bool = True
    min_sampling_ratio: float = 0.0
    compulsory_labels: tuple[int, ...] = (0, 1)
    rand_samples: int = 0
    min_numb_labels: int = 1
    proba_connect: bool = True
    evaluation_units: str = "foreground"
    do_mixup: bool = False
    mixup_alpha: float = 0.2
    mix_match: bool = False
    image: tuple[str, ...] = ()
    label: tuple[str, ...] = ()
    weight: tuple[str, ...] = ()
    sampler: tuple[str, ...] = ()
    inferred: tuple[str, ...] = ()


# Names and defaults of keys are fixed values: the public surface of configurations.
@dataclass(frozen=True)
class ClassificationSpec:
    num_classes: int = -1
    output_prob: bool = False
    label_normalisation: bool = False
    image: tuple[str, ...] = ()
    label: tuple[str, ...] = ()
    sampler: tuple[str, ...] = ()
    inferred: tuple[str, ...] = ()


@dataclass(frozen=True)
class RegressionSpec:
    loss_border: int = 0
    error_map: bool = False
    image: tuple[str, ...] = ()
    output: tuple[str, ...] = ()
    weight: tuple[str, ...] = ()
    sampler: tuple[str, ...] = ()
    inferred: tuple[str, ...] = ()


@dataclass(frozen=True)
class AutoencoderSpec:
    inference_type: str = ""
    noise_stddev: float = 0.0
    n_interpolations: int = 10
    image: tuple[str, ...] = ()
    feature: tuple[str, ...] = ()


@dataclass(frozen=True)
class GanSpec:
    noise_size: int = -1
    n_interpolations: int = 10
    image: tuple[str, ...] = ()
    conditioning: tuple[str, ...] = ()


@dataclass(frozen=True)
class RegistrationSpec:
    label_normalisation: bool = False
    fixed_image: tuple[str, ...] = ()
    fixed_label: tuple[str, ...] = ()
    moving_image: tuple[str, ...] = ()
    moving_label: tuple[str, ...] = ()


APPLICATION_SECTIONS = {
    "SEGMENTATION": SegmentationSpec, "CLASSIFICATION": ClassificationSpec, "REGRESSION": RegressionSpec,
    "AUTOENCODER": AutoencoderSpec, "GAN": GanSpec, "REGISTRATION": RegistrationSpec,
}
SECTIONS = {"SYSTEM": SystemSpec, "NETWORK": DataSpec, "TRAINING": TrainingSpec, "INFERENCE": InferenceSpec, "EVALUATION": EvaluationSpec} | APPLICATION_SECTIONS


def parse_value(text: str, kind: str):
    """F-S7, F-S8: a value of a field's type: bool, int, float, str, or a tuple written (a,b), {a,b} or a,b."""
    text = text.strip()
    if kind.startswith("tuple"):
        item = re.search(r"\[(\w+)", kind)[1]
        inner = re.sub(r"^[({]|[)}]$", "", text)
        return tuple(parse_value(x, item) for x in inner.split(",") if x.strip())
    if kind == "bool":
        low = text.lower()
        if low in ("yes", "true", "t", "y", "1"):
            return True
        if low in ("no", "false", "f", "n", "0"):
            return False
        raise ValueError(f"no boolean: {text}")
    return {"int": int, "float": float}.get(kind, str)(text)


def parse_section(spec, values: dict[str, str]):
    """PF15: a specification with the values of a section; an unknown key is an error with a hint."""
    types = {f.name: str(f.type) for f in fields(spec)}
    return replace(spec, **{look_up(k, types): parse_value(v, types[k]) for k, v in values.items()})


@dataclass(frozen=True)
class PipelineSpec:
    """A whole run: known sections by name, all others as input sections."""

    sections: dict
    sources: dict


def read_config(text: str, overrides: dict[str, dict[str, str]] | None = None) -> PipelineSpec:
    """2.15: INI text -> PipelineSpec. Overrides reach the known sections only, never the inputs."""
    parser = configparser.ConfigParser()
    parser.read_string(text)
    known, sources = {}, {}
    for name in parser.sections():
        values = dict(parser[name])
        if name.upper() in SECTIONS:
            known[name.upper()] = parse_section(SECTIONS[name.upper()](), values | (overrides or {}).get(name.upper(), {}))
        else:
            sources[name] = parse_section(SourceSpec(), values)
    for name, cls in SECTIONS.items():
        known.setdefault(name, parse_section(cls(), (overrides or {}).get(name, {})))
    return PipelineSpec(known, sources)
