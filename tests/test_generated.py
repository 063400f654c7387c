"""Generated rows leave a task in few frames, whatever pieces the generator gives."""

import pandas as pd

from arraymill.streaming import pipeline as S

SCHEMA = "number long, item long, value double"


def make(number):
    if number % 2:
        yield pd.DataFrame({"item": [0, 1], "value": [1.0, 2.0], "number": number})
    yield number, 2, None
    if number % 5 == 0:
        yield pd.DataFrame({"number": [number], "item": [3], "value": [4.0]}).iloc[:0]


def test_small_pieces_are_gathered():
    pieces = (piece for n in range(1000) for piece in make(n))
    frames = list(S._gathered(pieces, ["number", "item", "value"], most=600))
    assert len(frames) <= 4
    assert sum(map(len, frames)) == 2000


def test_frames_and_rows(spark):
    want = sorted([(n, i, float(i + 1)) for n in range(20) if n % 2 for i in (0, 1)] + [(n, 2, None) for n in range(20)], key=str)
    numbers = spark.range(0, 20, 1, 3)
    for got in (S.generated_from(numbers, "id", make, SCHEMA), S.generated(spark, make, 0, 20, SCHEMA, 3)):
        assert sorted([tuple(r) for r in got.collect()], key=str) == want
    assert S.generated_from(numbers.where("id < 0"), "id", make, SCHEMA).count() == 0
