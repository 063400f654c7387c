"""Queries over rules of runs, shapes and windows, applied to every row of given tables, and over a stream that is resumed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import control as T
from ..operators import volume as V
from ..operators import windows as W
from ..sources.shared import shared_dir
from ..streaming import pipeline as S
from .queries_windows import _IMG, images
from .registry import query, table

_c = F.col


@query("""WITH r AS (SELECT c_custkey, c_custkey % 7 AS f, c_custkey % 7 + c_nationkey AS l, c_custkey % 4 AS e, c_custkey % 3 AS v FROM customer), t AS (SELECT *, unnest(range(f + 1, l + 1)) AS iteration FROM r)
SELECT c_custkey, iteration::BIGINT AS iteration, 'training' AS phase, 0 AS k FROM t
UNION ALL SELECT c_custkey, iteration, 'validation', unnest(range(1, v + 1))::INT FROM t WHERE e > 0 AND iteration % e = 0""")
def iter_schedule(spark, d):
    """ST4: the iterations of one run a customer, with starts, ends and validation steps of its own."""
    key = _c("c_custkey")
    runs = T.schedules(table(spark, d, "customer"), ["c_custkey"], key % 7, key % 7 + _c("c_nationkey"), key % 4, key % 3)
    return runs.select("c_custkey", _c("iteration").cast("long").alias("iteration"), "phase", "k")


@query("SELECT n AS number, i AS item, (n * n + i)::DOUBLE AS value FROM (SELECT c_custkey AS n FROM customer) t, range(3) u(i)")
def generated_rows(spark, d):
    """ST2: rows that a generator makes for each customer, in the tasks that hold them."""

    def make(number):
        for i in range(3):
            yield number, i, float(number * number + i)

    return S.generated_from(table(spark, d, "customer"), "c_custkey", make, "number long, item long, value double")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:16], lambda v: v::DOUBLE) AS a, list_transform(embedding[17:19], lambda v: abs(v::DOUBLE) + 0.5) AS p FROM embeddings),
r AS (SELECT vec_id, i, a[i + 1] AS v, p[i % 4 + 1] AS q, sqrt(pow(a[i % 4 + 1], 2) + pow(a[i % 4 + 5], 2) + pow(a[i % 4 + 9], 2)) AS n FROM e, range(16) t(i))
SELECT vec_id, (i // 4)::INT AS i, (i % 4)::INT AS j, round(CASE WHEN i % 4 = 3 OR i >= 12 THEN v ELSE v / n * q END, 6) + 0 AS value FROM r""")
def affine_with_pixdim(spark, d):
    """F-A13: the columns of an affine brought to the lengths of new voxel sizes, both from each embedding."""
    e = _c("embedding").cast("array<double>")
    rows = table(spark, d, "embeddings").select("vec_id", V.affine_column(F.slice(e, 1, 16), F.transform(F.slice(e, 17, 3), lambda v: F.abs(v) + 0.5)).alias("a"))
    cells = rows.select("vec_id", F.posexplode("a").alias("at", "v"))
    return cells.select("vec_id", F.expr("cast(at div 4 as int)").alias("i"), (_c("at") % 4).alias("j"), (F.round("v", 6) + 0).alias("value"))


_WANTED = "WITH {img}, w AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 1 THEN (c_custkey % 4)::INT ELSE X END AS x, CASE WHEN c_custkey % 5 > 2 THEN (c_custkey % 5)::INT ELSE Y END AS y, Z AS z FROM img)"


@query(_WANTED.format(img=_IMG) + " SELECT c_custkey::VARCHAR AS name, x, y, z FROM w UNION ALL SELECT 'nation ' || c_nationkey, max(x), max(y), max(z) FROM w JOIN customer USING (c_custkey) GROUP BY c_nationkey")
def window_size_rules(spark, d):
    """WS6, WS23: window sizes completed from each image, and the largest window of each nation."""
    key = _c("c_custkey")
    wanted = [F.when(key % 4 > 1, key % 4), F.when(key % 5 > 2, key % 5).otherwise(-1), F.lit(0)]
    sizes = images(spark, d).select("c_custkey", *[c.alias(a) for a, c in zip(V.AXES, W.completed_window(wanted, [_c("X"), _c("Y"), _c("Z")]), strict=True)])
    of = sizes.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    largest = W.largest_windows(of, ["c_nationkey"]).select(F.concat(F.lit("nation "), "c_nationkey").alias("name"), *V.AXES)
    return sizes.select(key.cast("string").alias("name"), *V.AXES).unionByName(largest)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'all' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'training,validation' ELSE 'training' END ELSE 'inference' END AS phases FROM orders""")
def phase_routing(spark, d):
    """PF4: the phases of an action, with and without validation, and an explicit phase that wins, for every order."""
    key = _c("o_orderkey")
    action = F.when(key % 3 == 0, "train").when(key % 3 == 1, "inference").otherwise("evaluation")
    phases = C.phases_column(action, F.when(key % 5 == 0, "all").when(key % 7 == 0, ""), key % 2 == 0)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(phases, ",").alias("phases"))


@query("SELECT page_id FROM pages WHERE coalesce(url, '') <> '' AND page_id % 3 <> 0 AND page_id % 5 <> 0")
def searched_sections(spark, d):
    """PF17: of sections with a page's url as their path, those without files of their own."""
    files = [F.when(_c("page_id") % n == 0, F.lit("a.csv")).alias(c) for n, c in ((3, "csv_file"), (5, "csv_data_file"))]
    return C.searched_sections(table(spark, d, "pages").select("page_id", _c("url").alias("path_to_search"), *files)).select("page_id")


_DIMS = [("vec_id % 3 + 1", "vec_id % 5 + 1"), ("vec_id % 3 + 1", "vec_id % 2 + 1", "vec_id % 5 + 1"), ("vec_id % 3 + 1", "1", "vec_id % 5 + 1", "4"), ("1", "vec_id % 3 + 1", "vec_id % 5 + 1", "4", "3"), ("vec_id % 3 + 1", "2", "vec_id % 2 + 1", "4", "1", "3")]


@query(f"""WITH s AS (SELECT vec_id, CASE vec_id % 11 % 5 {" ".join(f"WHEN {i} THEN [{', '.join(v)}]" for i, v in enumerate(_DIMS))} END AS s FROM embeddings),
f AS (SELECT vec_id, CASE WHEN len(s) = 6 THEN s[1:4] || s[6:6] ELSE s || list_resize([]::BIGINT[], 5 - len(s), 1) END AS s FROM s)
SELECT vec_id, array_to_string(list_filter(s[1:3], lambda n: n <> 1) || list_filter(s[1:3], lambda n: n = 1) || s[4:5], ',') AS shape FROM f""")
def expanded_shapes(spark, d):
    """SC13, SC16: shapes of rank 2 to 6 as five axes, single spatial axes last, one for every embedding."""
    shapes = [F.array(*[F.expr(e).cast("int") for e in dims]) for dims in _DIMS]
    kind = _c("vec_id") % 11 % 5
    shape = F.when(kind == 0, shapes[0])
    for i, s in enumerate(shapes[1:], 1):
        shape = shape.when(kind == i, s)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(V.expanded_shape(shape).cast("array<string>"), ",").alias("shape"))


@query(f"WITH {_IMG} SELECT c_custkey, trunc((X - c_custkey % X) * 1.0 / 0.5)::INT AS x, trunc((c_custkey % Z) * 2.0 / 1.6)::INT AS y, trunc((Y - c_custkey % Y) * 1.5 / 2.0)::INT AS z FROM img")
def transformed_centres(spark, d):
    """WS18: a centre in each image, in RAS, turned to LSP and resampled from voxels of 1, 1.5 and 2 to 0.5, 1.6 and 2."""
    size = [_c("X"), _c("Y"), _c("Z")]
    centre = W.transformed_centre([_c("c_custkey") % n for n in size], size, "RAS", "LSP", (1.0, 1.5, 2.0), (0.5, 1.6, 2.0))
    return images(spark, d).select("c_custkey", *[c.alias(a) for a, c in zip(V.AXES, centre, strict=True)])


@query("SELECT c_custkey, c_acctbal::DOUBLE AS balance, 1::BIGINT AS times, true AS stopped FROM customer")
def stream_stopped_and_resumed(spark, d):
    """ST6, ST17, ST20: a run over files of customers that a step stops after its second batch, and a second run from the
    same checkpoint to the end: every row is in the sink once."""
    root = f"{shared_dir(spark)}/resume-{uuid.uuid4().hex}"
    rows = table(spark, d, "customer").select("c_custkey", _c("c_acctbal").cast("double").alias("balance"))
    rows.repartition(4, "c_custkey").write.parquet(f"{root}/in")
    sink = S.keyed_sink(f"{root}/out")

    def step(batch, number):
        sink(batch, number)
        return number < 1

    first = S.run(S.source(spark, f"{root}/in", 1), step, f"{root}/c")
    first.awaitTermination()
    some = spark.read.parquet(f"{root}/out").select(F.count("*").alias("__n"))
    begun = some.first()[0]
    S.run(S.source(spark, f"{root}/in", 1), sink, f"{root}/c").awaitTermination()
    done = spark.read.parquet(f"{root}/out")
    total = done.count()
    counts = done.groupBy("c_custkey", "balance").agg(F.count("*").alias("times"))
    return counts.withColumn("stopped", F.lit(first.stopped.is_set() and 0 < begun < total))
