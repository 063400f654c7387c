"""Distributed quantiles against numpy, and their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraymill.operators import intensity as I
from arraymill.operators import quantiles as Q


@pytest.fixture(scope="module")
def rows(spark):
    """Groups of 1 to 4000 values, ties, negative values, a null key, nulls, and a group without values."""
    rng = np.random.default_rng(1)
    groups = {"one": [5.0], "two": [-1.0, 3.0], "equal": [2.0] * 700, "few": rng.integers(-3, 4, 3000).astype(float), "many": rng.normal(size=4000), None: rng.normal(size=50)}
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("few", None), (None, None)]
    return groups, spark.createDataFrame(data, "k string, v double").repartition(5)


PS = (0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1.0)


def test_linear_quantiles(rows):
    groups, df = rows
    got = {r.k: list(r)[1:] for r in Q.quantiles(df, ["k"], F.col("v"), {f"q{i}": Q.linear(p) for i, p in enumerate(PS)}).collect()}
    assert got.pop("none") == [None] * len(PS)
    assert got.keys() == groups.keys()
    assert all(np.allclose(got[k], np.quantile(v, PS)) for k, v in groups.items())


def test_plotting_positions(rows):
    groups, df = rows
    got = {r.k: list(r)[1:] for r in I.mquantiles(df, ["k"], "v", (0.1, 0.25, 0.75)).collect()}
    for k, v in groups.items():
        v, n = np.sort(v), len(v)
        for p, x in zip((0.1, 0.25, 0.75), got[k], strict=True):
            at = n * p + 0.4 + 0.2 * p
            low = int(np.floor(np.clip(at, 1, max(1, n - 1))))
            rest = np.clip(at - low, 0, 1) if n > 1 else 0.0
            assert x == pytest.approx((1 - rest) * v[low - 1] + rest * v[min(low, n - 1)])


def test_landmarks_and_region_statistics_keep_all_groups(rows):
    groups, df = rows
    marks = {r.k: r.landmarks for r in I.landmarks(df, ["k"], "v").collect()}
    assert marks.pop("none") is None
    assert all(np.allclose(marks[k], np.quantile(v, (0.01, *I.INNER, 0.99))) for k, v in groups.items())
    stats = {r.k: r for r in I.region_stats(df, ["k"], "v").collect()}
    assert stats["none"].median is None and stats.keys() == {*groups, "none"}
    assert all(stats[k].median == pytest.approx(np.median(v)) for k, v in groups.items())


def test_a_group_spreads_over_parts(spark):
    """One group with all values: no percentile buffer, no window over the group, parts of about equal size."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 20011).cast("double").alias("v"))
    out = Q.cumulated(df, ["k"], F.col("v"))
    plan = out._jdf.queryExecution().toString()
    assert "percentile" not in plan
    windows = [line for line in plan.split("\n") if "Window [" in line and "n#" in line and "AS upto" in line]
    assert windows and all("__part" in w.rsplit("[", 2)[-2] for w in windows)
    sizes = sorted(r["count"] for r in df.repartitionByRange(4, "k", "v").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[0]
    assert out.where("upto = 10000").first().v == sorted(i * 7919 % 20011 for i in range(20_000))[9_999]
