"""Queries over windows, borders, components and texture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import surface as B
from ..operators import texture as T
from ..operators import volume as V
from ..operators import windows as W
from .queries_volume import SHAPE, VOX, K, rounded, vox
from .registry import query, table


def images(spark, d):
    """Every customer as an image whose size follows from its key."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", (k % 13 + 8).cast("int").alias("X"), (k % 7 + 9).cast("int").alias("Y"), (k % 5 + 6).cast("int").alias("Z"))


_IMG = "img AS (SELECT c_custkey, (c_custkey % 13 + 8)::INT AS X, (c_custkey % 7 + 9)::INT AS Y, (c_custkey % 5 + 6)::INT AS Z FROM customer)"


def _steps(size: str, window: int, step: int) -> str:
    base = f"list_distinct(list_append(range(0, {size} - {window} + 1, {step}), {size} - {window}))"
    two = f"CASE WHEN len({base}) = 2 THEN list_append({base}, round_even(list_sum({base}) / 2.0, 0)::BIGINT) ELSE {base} END"
    return f"list_distinct({two})"


def _order(size: str, window: int, step: int, at: str) -> str:
    """Place of a start in step order: the middle of exactly two comes last."""
    regular = f"len(list_distinct(list_append(range(0, {size} - {window} + 1, {step}), {size} - {window})))"
    return f"CASE WHEN {regular} = 2 THEN CASE WHEN {at} = 0 THEN 0 WHEN {at} = {size} - {window} THEN 1 ELSE 2 END ELSE ceil({at} / {step}.0)::INT END"


_GRID = f"""{_IMG}, g AS (SELECT c_custkey, X, Y, Z, x0, y0, z0, len({_steps('X', 6, 4)}) AS nx, len({_steps('Z', 5, 5)}) AS nz,
 {_order('X', 6, 4, 'x0')} AS ix, {_order('Y', 8, 4, 'y0')} AS iy, {_order('Z', 5, 5, 'z0')} AS iz
 FROM img, unnest({_steps('X', 6, 4)}) a(x0), unnest({_steps('Y', 8, 4)}) b(y0), unnest({_steps('Z', 5, 5)}) c(z0))"""


@query(f"WITH {_IMG} SELECT c_custkey, list_sum({_steps('X', 6, 4)})::BIGINT AS total, len({_steps('X', 6, 4)})::INT AS n FROM img")
def grid_steps(spark, d):
    s = W.step_points_column(F.col("X"), 6, 4)
    return images(spark, d).select("c_custkey", F.aggregate(s, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.size(s).alias("n"))


@query(f"WITH {_GRID} SELECT c_custkey, ((iy * nx + ix) * nz + iz)::INT AS seq, x0::INT AS x0, y0::INT AS y0, z0::INT AS z0, (x0 + 6)::INT AS x1, (y0 + 8)::INT AS y1, (z0 + 5)::INT AS z1 FROM g")
def grid_coords(spark, d):
    return W.grid_windows(images(spark, d), "c_custkey", (6, 8, 5), (1, 2, 0))


def _volumes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *[F.lit(4).alias(a) for a in "XYZ"])


_W3 = "s AS (SELECT * FROM (VALUES (0, 0), (1, 1)) t(s, i)), s1 AS (SELECT 0 AS s, 0 AS i UNION ALL SELECT 2, 1 UNION ALL SELECT 1, 2)"


@query(f"""WITH {VOX}, {_W3} SELECT vec_id, ((b.i * 2 + a.i) * 3 + c.i)::INT AS seq, a.s AS x0, b.s AS y0, c.s AS z0, x - a.s AS x, y - b.s AS y, z - c.s AS z, value
FROM vox, (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 2)) t(s, i) WHERE i < 2) a, (SELECT * FROM (VALUES (0, 0), (1, 1)) t(s, i)) b, s1 c
WHERE x BETWEEN a.s AND a.s + 2 AND y BETWEEN b.s AND b.s + 2 AND z BETWEEN c.s AND c.s + 1""", name="grid_windows_plain")
def grid_windows_plain(spark, d):
    """Windows of 3 x 3 x 2 with step 2 on z; on x and y two starts 0 and 1 whose mean 0.5 rounds to 0."""
    return W.cut_windows(vox(spark, d), _volumes(spark, d), "vec_id", (3, 3, 2))


@query(f"WITH {VOX} SELECT vec_id, x, y, z, value FROM vox")
def grid_roundtrip(spark, d):
    v = vox(spark, d)
    return W.assemble(W.cut_windows(v, _volumes(spark, d), "vec_id", (3, 2, 2)), v, "vec_id").select("vec_id", *V.AXES, "value")


@query(f"WITH {VOX} SELECT vec_id, x, y, z, CASE WHEN x IN (1, 2) AND y IN (1, 2) AND z IN (1, 2) THEN value ELSE 0.5731 END AS value FROM vox")
def grid_border_fill(spark, d):
    """Windows of 3 with border 1 step by one voxel; without padding, the outer voxels stay at the constant."""
    v = vox(spark, d)
    cut = W.crop_windows(W.cut_windows(v, _volumes(spark, d), "vec_id", (3, 3, 3), (1, 1, 1)), (3, 3, 3), (1, 1, 1))
    return W.assemble(cut, v, "vec_id", 0.5731).select("vec_id", *V.AXES, "value")


def _lcg(x: str) -> str:
    return f"((({x}) * 1103515245 + 12345) % 2147483648)"


def _u(key: str, draw: str, axis: int, seed: int) -> str:
    return f"floor({_lcg(_lcg(f'{key} * 7919 + {draw} * 104729 + {axis * 1299709} + {seed}'))} / 65536)::BIGINT"


@query(f"""WITH {_IMG}, r AS (SELECT *, draw::INT AS draw FROM (SELECT img.*, unnest(range(4)) AS draw FROM img)),
s AS (SELECT c_custkey, draw::INT AS draw, ({_u('c_custkey', 'draw', 0, 3)} % (X - 5))::INT AS x0, ({_u('c_custkey', 'draw', 1, 3)} % (Y - 7))::INT AS y0, ({_u('c_custkey', 'draw', 2, 3)} % (Z - 4))::INT AS z0 FROM (SELECT img.*, unnest(range(4)) AS draw FROM img) r)
SELECT *, x0 + 6 AS x1, y0 + 8 AS y1, z0 + 5 AS z1 FROM s""")
def uniform_windows(spark, d):
    return W.uniform_windows(images(spark, d), "c_custkey", (6, 8, 5), 4, 3)


@query(f"""WITH {VOX}, f AS (SELECT vec_id, x, y, z, value - least(min(value) OVER (PARTITION BY vec_id), 0) AS v FROM vox WHERE x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 2 AND z BETWEEN 0 AND 3),
c AS (SELECT *, sum(v) OVER (PARTITION BY vec_id ORDER BY v, x, y, z ROWS UNBOUNDED PRECEDING) / sum(v) OVER (PARTITION BY vec_id) AS p FROM f),
q AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY vec_id ORDER BY v, x, y, z), 0) AS q FROM c), t AS (SELECT k::INT AS draw FROM range(5) r(k))
SELECT vec_id, draw, x, y, z FROM q, t WHERE draw BETWEEN greatest(ceil(round(5 * (1 - p) - 0.5, 9)), 0) AND least(ceil(round(5 * (1 - q) - 0.5, 9)) - 1, 4)""")
def weighted_centres(spark, d):
    return W.weighted_centres(vox(spark, d), K, SHAPE, (2, 3, 1), 5)


@query(f"""WITH {VOX}, l AS (SELECT vec_id, x, y, z, (value > 0)::INT AS g FROM vox), n AS (SELECT vec_id, g, count(*) AS n FROM l GROUP BY ALL), k AS (SELECT vec_id, count(*) AS k FROM n GROUP BY 1)
SELECT vec_id, x, y, z, g, round(1.0 / (n * k), 9) AS p FROM l JOIN n USING (vec_id, g) JOIN k USING (vec_id)""")
def balanced_prob(spark, d):
    rows = vox(spark, d).select(*K, *V.AXES, (F.col("value") > 0).cast("int").alias("g"))
    return W.balanced_probabilities(rows, K, "g").select(*K, *V.AXES, "g", F.round("p", 9).alias("p"))


@query(f"""WITH {VOX}, l AS (SELECT vec_id, x, y, z, CASE WHEN value > 0.1 THEN 2 WHEN value > 0 THEN 1 ELSE 0 END AS g FROM vox),
w AS (SELECT a.vec_id, a.x, a.y, a.z, count(*) FILTER (b.g = 0) AS c0, count(*) FILTER (b.g = 1) AS c1, count(*) FILTER (b.g = 2) AS c2, count(*) AS n
 FROM l a JOIN l b ON a.vec_id = b.vec_id AND b.x BETWEEN a.x AND a.x + 1 AND b.y BETWEEN a.y AND a.y + 1 AND b.z BETWEEN a.z AND a.z + 2 GROUP BY ALL)
SELECT vec_id, x, y, z, ((c0 > 0)::INT + (c1 > 0)::INT + (c2 > 0)::INT) AS n_labels FROM w WHERE n = 12 AND (c0 > 0)::INT + (c1 > 0)::INT + (c2 > 0)::INT >= 2 AND c1 > 0 AND c1 >= 1.2 AND c2 > 0 AND c2 >= 1.2""")
def selective_candidates(spark, d):
    g = F.when(F.col("value") > 0.1, 2).when(F.col("value") > 0, 1).otherwise(0)
    return W.selective_candidates(vox(spark, d).withColumn("value", g), K, (2, 2, 3), W.Constraint((1, 2), 0.1, 2), [0, 1, 2])


@query(f"""WITH {VOX} SELECT a.vec_id, a.x, a.y, a.z, round(sum(b.value), 6) AS value FROM vox a JOIN vox b ON a.vec_id = b.vec_id AND b.x BETWEEN a.x AND a.x + 1 AND b.y BETWEEN a.y AND a.y + 2 AND b.z = a.z
GROUP BY ALL HAVING count(*) = 6""")
def box_sums(spark, d):
    return rounded(W.box_sums(vox(spark, d), K, (2, 3, 1)))


@query("""WITH c AS (SELECT doc_id, n_chars % 3 AS size, source FROM documents), n AS (SELECT source, size, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT source, count(*) AS k FROM n GROUP BY 1)
SELECT doc_id, source, size, round(1.0 / (n * k), 9) AS p FROM c JOIN n USING (source, size) JOIN k USING (source)""")
def size_weights(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") % 3).alias("size"))
    return W.size_weights(rows, ["source"], "size").select("doc_id", "source", "size", F.round("p", 9).alias("p"))


@query(f"""WITH r AS (SELECT doc_id, source, CASE WHEN n_chars > 0 THEN -ln(({_lcg(_lcg('doc_id * 7919 + 5'))} + 1) / 2147483649.0) / n_chars END AS r FROM documents)
SELECT doc_id, source FROM r WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY r NULLS LAST, doc_id) <= 10""")
def weighted_choice(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return W.weighted_choice(rows, ["source"], "n_chars", "doc_id", 10, 5).select("doc_id", "source")


@query("""SELECT a.vec_id, round(m, 6) AS m, round(a.embedding[1]::DOUBLE * m + b.embedding[1]::DOUBLE * (1 - m), 6) AS v0, round(a.embedding[64]::DOUBLE * m + b.embedding[64]::DOUBLE * (1 - m), 6) AS v63
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, (SELECT k / 4.0::DOUBLE AS m FROM range(5) t(k))""")
def interp_vectors(spark, d):
    cast = F.transform("embedding", lambda v: v.cast("double"))
    e = table(spark, d, "embeddings")
    pairs = e.select("vec_id", cast.alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), cast.alias("b")), "vec_id")
    out = W.interpolated(pairs, "a", "b", 5)
    return out.select("vec_id", F.round("m", 6).alias("m"), F.round(F.col("vector")[0], 6).alias("v0"), F.round(F.col("vector")[63], 6).alias("v63"))


@query(f"""WITH {_IMG}, p AS (SELECT c_custkey, X, Y, Z, (c_custkey * 5 % 11 - 3)::INT AS x0, (c_custkey * 3 % 13 - 4)::INT AS y0, (c_custkey % 9 - 2)::INT AS z0 FROM img),
o AS (SELECT *, greatest(-x0, 0) + greatest(x0 + 6 - X, 0) + greatest(-y0, 0) + greatest(y0 + 8 - Y, 0) + greatest(-z0, 0) + greatest(z0 + 5 - Z, 0) AS outside FROM p)
SELECT c_custkey, x0, y0, z0, outside::BIGINT AS outside, outside = 0 AS valid FROM o""")
def csv_centres(spark, d):
    k = F.col("c_custkey")
    centres = table(spark, d, "customer").select("c_custkey", (k * 5 % 11).cast("int").alias("x"), (k * 3 % 13).cast("int").alias("y"), (k % 9).cast("int").alias("z"))
    rows = W.csv_patches(centres, images(spark, d), "c_custkey", (6, 8, 5), "pad")
    outside = sum((F.col(f"pad_{a}_{s}") for a in V.AXES for s in ("low", "high")), F.lit(0)).cast("long")
    return rows.select("c_custkey", "x0", "y0", "z0", outside.alias("outside"), "valid")


@query("SELECT o_orderkey, (i // 64)::BIGINT AS batch FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i // 64 < n // 64")
def batches_drop(spark, d):
    from ..operators.catalog import global_rank

    rows = global_rank(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")]).select("o_orderkey", (F.col("rank") - 1).alias("i"))
    return W.batches(rows, "i", 64, "drop").select("o_orderkey", "batch")


@query("""WITH r AS (SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 64)::BIGINT AS batch FROM orders)
SELECT o_orderkey, batch FROM r UNION ALL SELECT -1, batch FROM (SELECT batch, unnest(range(64 - count(*))) FROM r GROUP BY batch HAVING count(*) < 64)""")
def batches_pad(spark, d):
    from ..operators.catalog import global_rank

    rows = global_rank(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")]).select("o_orderkey", (F.col("rank") - 1).alias("i"))
    return W.batches(rows, "i", 64, "pad").select("o_orderkey", "batch")


@query("SELECT n_name, epoch::INT AS epoch FROM nation, range(3) t(epoch)")
def epochs(spark, d):
    return W.repeated(table(spark, d, "nation").select("n_name"), 3)


@query("""WITH r AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY len(n_name), n_nationkey) AS u, row_number() OVER (PARTITION BY n_regionkey ORDER BY len(n_name) DESC, n_nationkey DESC) AS d FROM nation)
SELECT x.n_regionkey, x.n_nationkey AS a, y.n_nationkey AS b FROM r x JOIN r y ON x.n_regionkey = y.n_regionkey AND x.u = y.d""")
def mix_match(spark, d):
    rows = table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.length("n_name").alias("volume"))
    return W.mix_match(rows, "n_regionkey", "n_nationkey", "volume")


@query("SELECT l_orderkey, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) - 1)::VARCHAR || '_' || l_orderkey || '_seg' AS output FROM lineitem")
def numbered_outputs(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return W.numbered_outputs(rows, "l_orderkey", ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity"], "seg").select("l_orderkey", "l_partkey", "output")


# surfaces and components: a volume's positive voxels are inferred, those of its class's mean volume are the reference

_MASKS = f"""{VOX}, m AS (SELECT vec_id, x, y, z, value > 0 AS seg, avg(value) OVER (PARTITION BY label, x, y, z) > 0 AS ref FROM vox)"""
_S6 = "st AS (SELECT * FROM (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(dx,dy,dz))"


def masks(spark, d):
    from pyspark.sql import Window

    v = vox(spark, d, ["label"])
    mean = F.avg("value").over(Window.partitionBy("label", *V.AXES))
    both = v.select(*K, *V.AXES, (F.col("value") > 0).alias("seg"), (mean > 0).alias("ref"))
    return both.where("seg").select(*K, *V.AXES), both.where("ref").select(*K, *V.AXES)


def _border_join(side: str) -> str:
    return f"""b{side} AS (SELECT f.vec_id, f.x, f.y, f.z FROM (SELECT vec_id, x, y, z FROM m WHERE {side}) f CROSS JOIN st LEFT JOIN (SELECT vec_id, x, y, z FROM m WHERE {side}) n
 ON n.vec_id = f.vec_id AND n.x = f.x + dx AND n.y = f.y + dy AND n.z = f.z + dz GROUP BY ALL HAVING count(n.vec_id) < 6)"""


@query(f"WITH {_MASKS}, {_S6}, {_border_join('seg')} SELECT vec_id, x, y, z FROM bseg")
def border_map(spark, d):
    return B.border(masks(spark, d)[0], K)


_DIST = f"""{_MASKS}, {_S6}, {_border_join('seg')}, {_border_join('ref')},
d1 AS (SELECT a.vec_id, a.x, a.y, a.z, sqrt(min(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2))) AS d FROM bseg a JOIN bref b ON a.vec_id = b.vec_id GROUP BY ALL),
d2 AS (SELECT a.vec_id, a.x, a.y, a.z, sqrt(min(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2))) AS d FROM bref a JOIN bseg b ON a.vec_id = b.vec_id GROUP BY ALL)"""


@query(f"WITH {_DIST} SELECT vec_id, x, y, z, round(d, 6) AS distance FROM d1")
def border_distance(spark, d):
    seg, ref = masks(spark, d)
    return B.field_distances(B.border(seg, K), B.border(ref, K), K).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_DIST}, s1 AS (SELECT vec_id, sum(d) AS s, max(d) AS m, quantile_cont(d, 0.95) AS q FROM d1 GROUP BY 1), s2 AS (SELECT vec_id, sum(d) AS s, max(d) AS m, quantile_cont(d, 0.95) AS q FROM d2 GROUP BY 1),
u AS (SELECT vec_id, count(*) AS n FROM (SELECT * FROM bseg UNION SELECT * FROM bref) GROUP BY 1)
SELECT vec_id, round((s1.s + s2.s) / n, 6) AS average_distance, round(greatest(s1.m, s2.m), 6) AS hausdorff_distance, round(greatest(s1.q, s2.q), 6) AS hausdorff95_distance FROM s1 JOIN s2 USING (vec_id) JOIN u USING (vec_id)""")
def surface_distances(spark, d):
    out = B.surface_distances(*masks(spark, d), K)
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def _components(side: str) -> str:
    return f"""f{side} AS (SELECT vec_id, x * 16 + y * 4 + z AS p, x, y, z FROM m WHERE {side}),
e{side} AS (SELECT a.vec_id, a.p, b.p AS q FROM f{side} a JOIN f{side} b ON a.vec_id = b.vec_id AND abs(a.x-b.x) + abs(a.y-b.y) + abs(a.z-b.z) <= 1),
r{side}(vec_id, p, q) AS (SELECT vec_id, p, q FROM e{side} UNION SELECT r.vec_id, r.p, e.q FROM r{side} r JOIN e{side} e ON r.vec_id = e.vec_id AND r.q = e.p),
c{side} AS (SELECT vec_id, (p // 16)::INT AS x, ((p // 4) % 4)::INT AS y, (p % 4)::INT AS z, (dense_rank() OVER (PARTITION BY vec_id ORDER BY c))::INT AS component FROM (SELECT vec_id, p, min(q) AS c FROM r{side} GROUP BY ALL))"""


_CC = f"RECURSIVE {_MASKS}, {_components('seg')}, {_components('ref')}"


def labelled(spark, d):
    seg, ref = masks(spark, d)
    return B.components(seg, K, shape=SHAPE), B.components(ref, K, shape=SHAPE)


@query(f"WITH RECURSIVE {_MASKS}, {_components('seg')} SELECT vec_id, x, y, z, component FROM cseg")
def components(spark, d):
    return labelled(spark, d)[0]


@query(f"WITH RECURSIVE {_MASKS}, {_components('seg')} SELECT vec_id, component, count(*) AS size FROM cseg GROUP BY ALL")
def component_sizes(spark, d):
    return B.component_sizes(labelled(spark, d)[0], K).select("vec_id", "component", "size").distinct()


@query(f"""WITH {_CC} SELECT r.vec_id, r.component AS ref_id, coalesce(string_agg(DISTINCT s.component::VARCHAR, '&' ORDER BY s.component::VARCHAR), '') AS seg_ids
FROM cref r LEFT JOIN cseg s USING (vec_id, x, y, z) GROUP BY ALL""")
def component_overlap(spark, d):
    out = B.overlaps(*labelled(spark, d), K)
    return out.select("vec_id", "ref_id", F.array_join(F.array_sort(F.transform("seg_ids", lambda x: x.cast("string"))), "&").alias("seg_ids"))


_ERR = f"""{_CC}, j AS (SELECT coalesce(r.vec_id, s.vec_id) AS vec_id, coalesce(r.x, s.x) AS x, coalesce(r.y, s.y) AS y, coalesce(r.z, s.z) AS z, r.component AS r, s.component AS s FROM cref r FULL JOIN cseg s ON r.vec_id = s.vec_id AND r.x = s.x AND r.y = s.y AND r.z = s.z),
gr AS (SELECT DISTINCT vec_id, r FROM j WHERE r IS NOT NULL AND s IS NOT NULL), gs AS (SELECT DISTINCT vec_id, s FROM j WHERE r IS NOT NULL AND s IS NOT NULL),
t AS (SELECT j.*, gr.r IS NOT NULL AS okr, gs.s IS NOT NULL AS oks FROM j LEFT JOIN gr ON gr.vec_id = j.vec_id AND gr.r = j.r LEFT JOIN gs ON gs.vec_id = j.vec_id AND gs.s = j.s)"""


@query(f"WITH {_ERR} SELECT vec_id, x, y, z, r IS NOT NULL AS in_ref, s IS NOT NULL AS in_seg, (okr OR oks)::INT AS tpc, (r IS NOT NULL AND NOT okr)::INT AS fnc, (s IS NOT NULL AND NOT oks)::INT AS fpc FROM t")
def error_maps(spark, d):
    return B.error_maps(*labelled(spark, d), K)


@query(f"""WITH {_ERR} SELECT vec_id, count(DISTINCT r) FILTER (okr) AS tp_components, count(DISTINCT s) FILTER (NOT oks) AS fp_components, count(DISTINCT r) FILTER (NOT okr) AS fn_components,
 round(2.0 * (count(*) FILTER (r IS NULL AND s IS NOT NULL AND (okr OR oks)) + count(*) FILTER (r IS NOT NULL AND NOT (s IS NOT NULL AND (okr OR oks)))) / (count(r) + count(s)), 6) AS oer,
 count(*) FILTER (r IS NULL AND s IS NOT NULL AND (okr OR oks)) AS oefp, count(*) FILTER (r IS NOT NULL AND NOT (s IS NOT NULL AND (okr OR oks))) AS oefn,
 count(*) FILTER (s IS NOT NULL AND NOT oks) + count(*) FILTER (r IS NOT NULL AND NOT okr) AS de, count(*) FILTER (s IS NOT NULL AND NOT oks) AS defp, count(*) FILTER (r IS NOT NULL AND NOT okr) AS defn
FROM t GROUP BY vec_id""")
def component_errors(spark, d):
    return B.component_errors(*labelled(spark, d), K).withColumn("oer", F.round("oer", 6))


@query(f"""WITH {_CC}, p AS (SELECT r.vec_id, r.component AS ref_id, s.component AS seg_id FROM cref r JOIN cseg s USING (vec_id, x, y, z)),
n AS (SELECT vec_id, component, count(*) AS n FROM cseg GROUP BY ALL),
g AS (SELECT vec_id, ref_id, string_agg(seg_id::VARCHAR, '&' ORDER BY seg_id) AS ids, sum(n)::BIGINT AS n_seg FROM (SELECT DISTINCT * FROM p) d JOIN n ON n.vec_id = d.vec_id AND n.component = seg_id GROUP BY d.vec_id, ref_id)
SELECT a.vec_id, 'r' || a.component || '_s' || coalesce(ids, '') AS cc_id, coalesce(tp, 0) AS tp, coalesce(n_seg, 0) - coalesce(tp, 0) AS fp, a.n - coalesce(tp, 0) AS fn
FROM (SELECT vec_id, component, count(*) AS n FROM cref GROUP BY ALL) a LEFT JOIN g ON g.vec_id = a.vec_id AND ref_id = a.component LEFT JOIN (SELECT vec_id, ref_id, count(*) AS tp FROM p GROUP BY ALL) h ON h.vec_id = a.vec_id AND h.ref_id = a.component""".replace("SELECT vec_id, ref_id, string_agg", "SELECT d.vec_id, ref_id, string_agg"))
def component_metrics(spark, d):
    return B.component_metrics(*labelled(spark, d), K)


@query(f"""WITH {VOX}, m AS (SELECT vec_id, x, y, z, value, value > 0 AS seg FROM vox), {_S6}, {_border_join('seg')},
j AS (SELECT m.*, b.vec_id IS NOT NULL AS b FROM m LEFT JOIN bseg b USING (vec_id, x, y, z) WHERE seg)
SELECT vec_id, round(sum(value) * 1.5, 6) AS vol_prob, round(count(*) * 1.5::DOUBLE, 6) AS vol, round(sum(value) FILTER (b) * 1.5, 6) AS surf_prob, round(count(*) FILTER (b) * 1.5::DOUBLE, 6) AS surf,
 round(avg(x) FILTER (value > 0.05), 6) AS centre_x, round(avg(y) FILTER (value > 0.05), 6) AS centre_y, round(avg(z) FILTER (value > 0.05), 6) AS centre_z,
 round(count(*) FILTER (b) / count(*), 6) AS sav, round(pow(count(*) FILTER (b) * 1.5, 1.5) / (count(*) * 1.5), 6) AS compactness FROM j GROUP BY vec_id""")
def surface_volume(spark, d):
    out = B.region_shape(vox(spark, d), K, 1.5, 0.05)
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(f"""WITH {VOX} SELECT vec_id, round(sum(value * x) / sum(value) * 2, 5) AS com_x, round(sum(value * y) / sum(value) * 2, 5) AS com_y, round(sum(value * z) / sum(value) * 2, 5) AS com_z FROM (SELECT vec_id, x, y, z, abs(value) AS value FROM vox) GROUP BY 1""")
def centre_of_mass(spark, d):
    from ..operators.confusion import centre_of_mass as com

    out = com(vox(spark, d).withColumn("value", F.abs("value")), K, "value", list(V.AXES), 2.0)
    return out.select("vec_id", *[F.round(c, 5).alias(c) for c in out.columns[1:]])


@query(f"""WITH {VOX}, {_S6}, m AS (SELECT vec_id, x, y, z FROM vox WHERE value > 0.15)
SELECT DISTINCT vec_id, x, y, z FROM (SELECT * FROM m UNION ALL SELECT vec_id, x + dx, y + dy, z + dz FROM m, st) WHERE x BETWEEN 0 AND 3 AND y BETWEEN 0 AND 3 AND z BETWEEN 0 AND 3""")
def mask_dilated(spark, d):
    return B.dilated(vox(spark, d).where("value > 0.15").select(*K, *V.AXES), K, SHAPE)


@query(f"""WITH RECURSIVE {VOX}, m AS (SELECT vec_id, x, y, z, value > -0.15 AS fg FROM vox), {_S6},
o(vec_id, x, y, z) AS (SELECT vec_id, x, y, z FROM m WHERE NOT fg AND (x IN (0, 3) OR y IN (0, 3) OR z IN (0, 3)) UNION SELECT m.vec_id, m.x, m.y, m.z FROM o, st, m WHERE m.vec_id = o.vec_id AND m.x = o.x + dx AND m.y = o.y + dy AND m.z = o.z + dz AND NOT fg)
SELECT vec_id, x, y, z FROM m WHERE (vec_id, x, y, z) NOT IN (SELECT (vec_id, x, y, z) FROM o)""")
def mask_filled(spark, d):
    v = vox(spark, d)
    return B.filled(v.where("value > -0.15").select(*K, *V.AXES), v, K, SHAPE)


@query("SELECT doc_id, lang, lab::INT AS lab FROM documents, range(3) t(lab)")
def label_spine(spark, d):
    labels = spark.range(3).select(F.col("id").cast("int").alias("lab"))
    return B.label_spine(table(spark, d, "documents").select("doc_id", "lang"), labels)


_GLCM = f"""{VOX}, s AS (SELECT * FROM (VALUES (1,1,0,0),(2,-1,0,0),(3,0,1,0),(4,0,-1,0),(5,0,0,1),(6,0,0,-1)) t(shift,dx,dy,dz)),
l AS (SELECT vec_id, x, y, z, least(greatest(round_even(value * 10, 0) + 1, 0), 7)::INT AS g FROM vox),
n AS (SELECT a.vec_id, shift, a.g AS i, coalesce(b.g, 1) AS j, count(*) AS n FROM l a CROSS JOIN s LEFT JOIN l b ON b.vec_id = a.vec_id AND b.x = a.x - dx AND b.y = a.y - dy AND b.z = a.z - dz GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY vec_id, shift) AS p FROM n)"""


@query(f"WITH {_GLCM} SELECT vec_id, shift, i, j, n, round(p, 9) AS p FROM p")
def glcm(spark, d):
    return T.glcm(vox(spark, d), K, 6, 8, 10.0).withColumn("p", F.round("p", 9))


@query(f"""WITH {_GLCM}, f AS (SELECT vec_id, shift, sum(p*p) AS asm, sum(pow(j-i,2)*p) AS contrast, sum(p/(1+abs(i-j))) AS homogeneity, sum(p*ln(p)) AS entropy, sum(p/(1+pow(i-j,2))) AS idm, sum((i+j)*p) AS sum_average, sum(j*p)/64 AS mean FROM p GROUP BY ALL),
v AS (SELECT p.vec_id, p.shift, sum(pow(i - mean, 2) * p) AS ssv FROM p JOIN f USING (vec_id, shift) GROUP BY ALL),
k AS (SELECT vec_id, shift, i + j AS k, sum(p) AS q FROM p GROUP BY ALL), ke AS (SELECT vec_id, shift, sum(q*ln(q)) AS se FROM k GROUP BY ALL), kv AS (SELECT vec_id, shift, any_value(se) AS se, sum(pow(k - se, 2) * q) AS sv FROM k JOIN ke USING (vec_id, shift) GROUP BY ALL),
g AS (SELECT vec_id, shift, sum(k*k*q) AS dv, -sum(q*ln(q)) AS de FROM (SELECT vec_id, shift, abs(i-j) AS k, sum(p) AS q FROM p GROUP BY ALL) GROUP BY ALL),
lv AS (SELECT * FROM range(8) t(c)), cs AS (SELECT vec_id, shift, j AS c, sum(p) AS s FROM p GROUP BY ALL),
fs AS (SELECT f.vec_id, f.shift, c, coalesce(s, 0) AS s, c * coalesce(s, 0) AS mean, abs(c - c * coalesce(s, 0)) * sqrt(coalesce(s, 0)) AS sd FROM f CROSS JOIN lv LEFT JOIN cs USING (vec_id, shift, c)),
ab AS (SELECT a.vec_id, a.shift, a.c AS i, b.c AS j, a.s AS si, b.s AS sj, a.mean AS mi, b.mean AS mj, a.sd AS di, b.sd AS dj, coalesce(p, 0) AS p FROM fs a JOIN fs b ON a.vec_id = b.vec_id AND a.shift = b.shift LEFT JOIN p ON p.vec_id = a.vec_id AND p.shift = a.shift AND p.i = a.c AND p.j = b.c),
co AS (SELECT vec_id, shift, sum(CASE WHEN di > 0 AND dj > 0 THEN (i*j*p - mi*mj) / (di*dj) ELSE 0 END) AS correlation, -sum(p*ln(si*sj+0.001)) AS h1, -sum(si*sj*ln(si*sj+0.001)) AS h2 FROM ab GROUP BY ALL),
hx AS (SELECT vec_id, shift, -sum(s*ln(s+0.001)) AS hx FROM fs GROUP BY ALL)
SELECT vec_id, round(avg(asm),6) AS asm, round(avg(asm),6) AS energy, round(avg(contrast),6) AS contrast, round(avg(homogeneity),8) AS homogeneity, round(avg(entropy),6) AS entropy, round(avg(correlation),4) AS correlation, round(avg(idm),8) AS idm, round(avg(sum_average),6) AS sum_average,
 round(avg(se),6) AS sum_entropy, round(avg(sv),5) AS sum_variance, round(avg(dv),6) AS difference_variance, round(avg(de),6) AS difference_entropy, round(avg((entropy - h1) / nullif(hx, 0)),5) AS imc1,
 round(avg(CASE WHEN entropy = 0 THEN 0 ELSE sqrt(greatest(1 - exp(-2 * (h2 - entropy)), 0)) END),5) AS imc2, round(avg(ssv),6) AS sum_square_variance
FROM f JOIN v USING (vec_id, shift) JOIN kv USING (vec_id, shift) JOIN g USING (vec_id, shift) JOIN co USING (vec_id, shift) JOIN hx USING (vec_id, shift) GROUP BY vec_id""")
def haralick(spark, d):
    out = T.haralick(T.glcm(vox(spark, d), K, 6, 8, 10.0), K, 8)
    digits = {"correlation": 4, "sum_variance": 5, "imc1": 5, "imc2": 5, "homogeneity": 8, "idm": 8}
    return out.select("vec_id", *[F.round(c, digits.get(c, 6)).alias(c) for c in out.columns[1:]])
