"""Groups that share a batch are labelled apart, and displacements drawn in frames are those of each key alone."""

import numpy as np

from arraymill.operators import splines, surface


def test_labels_of_many_groups():
    group = np.array([0, 0, 0, 1, 1, 2, 2])
    x = np.array([0, 2, 1, 0, 3, 3, 0])
    flat = np.zeros(7, int)
    assert surface._labels(group, x, flat, flat).tolist() == [1, 1, 1, 1, 2, 2, 1]


def test_drawn_fields(spark):
    keys = spark.range(1200).withColumnRenamed("id", "k")
    got = {r.k: r for r in splines.normal_field(keys, ["k"], 2, 1.5, 9).where("component = 2 and x = 1 and y = 0 and z = 1").collect()}
    assert len(got) == 1200
    for k in (0, 499, 500, 1199):
        rng = np.random.default_rng([9, k])
        drawn = [rng.normal(0, 1.5, (2, 2, 2)) for _ in range(3)]
        assert got[k].value == drawn[2][1, 0, 1]
