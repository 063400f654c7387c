"""The dense CRF deals small volumes to partitions once a round; results are the same however volumes are dealt."""

import itertools
import random

from pyspark.sql import functions as F

from arraymill.operators import lattice as L

KIND = "k int, x int, y int, z int, value double"


def test_crf_shuffles_small_volumes_once(spark, monkeypatch):
    r = random.Random(1)
    rows = [(k, *c, r.uniform(-1, 1)) for k in (1, 2, 3) for c in itertools.product(range(4 if k == 3 else 2), repeat=3)]
    df = spark.createDataFrame(rows, KIND).withColumn("b", -F.col("value"))
    plans, cut = [], L.co_partitioned

    def watched(df):
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        plans.append(df.select("*")._jdf.queryExecution().executedPlan().toString())
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        return cut(df)

    monkeypatch.setattr(L, "co_partitioned", watched)
    made = L.dense_crf(df, ["k"], ["value", "b"], ["value"], rounds=1)
    assert len(plans) == 2
    for plan in plans:
        assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") > 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    monkeypatch.setattr(L, "co_partitioned", cut)
    want = {(q.k, q.x, q.y, q.z): (q.value, q.b) for q in made.collect()}
    for most in (50,):
        monkeypatch.setattr(L, "DEALT", most)
        got = {(q.k, q.x, q.y, q.z): (q.value, q.b) for q in L.dense_crf(df, ["k"], ["value", "b"], ["value"], rounds=1).collect()}
        assert got.keys() == want.keys() and len(got) == len(rows)
        assert all(abs(a - b) < 1e-9 for c in want for a, b in zip(got[c], want[c], strict=True))
