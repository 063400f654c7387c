"""Transforms as layers (U4-U8), and registries of named factories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, intensity, volume
from .spec import look_up


class Layer:
    """U4, U8: a function of a DataFrame with a name; `then` chains layers into one lazy plan."""

    def __init__(self, name: str, apply: Callable[[DataFrame], DataFrame], inverse: Callable[[DataFrame], DataFrame] | None = None):
        self.name, self._apply, self._inverse = name, apply, inverse

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.transform(self._apply)

    def inverse(self, df: DataFrame) -> DataFrame:
        """U7."""
        if self._inverse is None:
            raise ValueError(f"{self.name} has no inverse")
        return df.transform(self._inverse)

    def then(self, other: Layer) -> Layer:
        undo = (lambda df: self.inverse(other.inverse(df))) if self._inverse and other._inverse else None
        return Layer(f"{self.name}+{other.name}", lambda df: other(self(df)), undo)


class Fitted:
    """fit(df) learns a model DataFrame once and gives a Layer; a model read from a table skips the fit."""

    def __init__(self, name: str, train: Callable[[DataFrame], DataFrame], apply: Callable[[DataFrame, DataFrame], DataFrame], inverse: Callable[[DataFrame, DataFrame], DataFrame] | None = None):
        self.name, self._train, self._use, self._undo = name, train, apply, inverse

    def fit(self, df: DataFrame, model: DataFrame | None = None) -> Layer:
        learned = model if model is not None else self._train(df)
        return Layer(self.name, lambda x: self._use(x, learned), (lambda x: self._undo(x, learned)) if self._undo else None)


def padding(keys: list[str], shape, border, mode: str = "minimum") -> Layer:
    grown = tuple(n + 2 * b for n, b in zip(shape, border, strict=True))
    return Layer("padding", lambda df: volume.pad(df, keys, shape, border, mode), lambda df: volume.unpad(df, grown, border))


def flipping(shape, axes) -> Layer:
    turn = lambda df: volume.flip(df, shape, axes)
    return Layer("flip", turn, turn)


def whitening(keys: list[str], value: str) -> Layer:
    return Layer("whitening", lambda df: intensity.whitened(df, keys, value).drop(value).withColumnRenamed("white", value))


def label_codes(column: str) -> Fitted:
    back = lambda df, m: catalog.unlabel(df, "code", m, "__label").drop("code").withColumnRenamed("__label", column)
    return Fitted("labels", lambda df: catalog.label_map(df, column), lambda df, m: catalog.relabel(df, column, m, "code").drop(column), back)


def seeded_flip(shape, probability: float, seed: int, key: str) -> Layer:
    """U6, F-A3: each volume and axis flipped with a probability, by a portable pseudo-random number of its key."""

    def apply(df: DataFrame) -> DataFrame:
        for i, a in enumerate(volume.AXES):
            u = catalog.portable_key(catalog.portable_key(F.col(key) * 7919 + i * 104729 + seed)) / F.lit(2147483648.0)
            df = df.withColumn(a, F.when(u < probability, F.lit(shape[i] - 1) - F.col(a)).otherwise(F.col(a)))
        return df

    return Layer("seeded_flip", apply, apply)


class Registry:
    """Named factories of one kind, here layers; plans/runs.py has those of samplers, metrics and applications. Unknown
    names are answered with the nearest."""

    def __init__(self, kind: str):
        self.kind, self._made = kind, {}

    def register(self, name: str):
        def add(f):
            self._made[name] = f
            return f

        return add

    def get(self, name: str):
        return self._made[look_up(name, self._made)]

    def create(self, name: str, *args, **more):
        return self.get(name)(*args, **more)

    def names(self) -> list[str]:
        return sorted(self._made)


LAYERS = Registry("layer")
for _name, _f in (("padding", padding), ("flip", flipping), ("whitening", whitening), ("labels", label_codes), ("seeded_flip", seeded_flip)):
    LAYERS.register(_name)(_f)
