"""Queries over the remaining operators of catalogs, metrics, intensities, geometry and samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import confusion as M
from ..operators import intensity as I
from ..operators import losses as L
from ..operators import pairs as P
from ..operators import volume as V
from ..operators import windows as W
from . import evaluation as E
from . import layers as Y
from . import runs as R
from .queries_catalog import _SPLIT, _partition, _sections
from .queries_volume import SHAPE, VOX, K, rounded, vox
from .queries_windows import _IMG, images
from .registry import query, table
from .spec import look_up, read_config

_LCS = """coalesce((SELECT max(k) FROM (SELECT unnest(range(1, len(a) + 1)) AS i) t, (SELECT unnest(range(1, 40)) AS k) u WHERE i + k - 1 <= len(a) AND contains(b, substr(a, i, k))), 0)"""


@query(f"WITH {_SPLIT}, c AS (SELECT doc_id FROM documents WHERE source = 'src0') SELECT phase, phase IN (SELECT p.phase FROM p JOIN c USING (doc_id)) AS present FROM (VALUES ('training'), ('validation'), ('inference')) t(phase)")
def phase_present(spark, d):
    """J4."""
    catalog, partition = _sections(spark, d)[0].where("image = 'src0'"), _partition(spark, d)
    return spark.createDataFrame([(p, C.has_phase(catalog, partition, p)) for p in C.PHASES], "phase string, present boolean")


_FUZZY = """s AS (SELECT left_id, right_id, b, {lcs} AS size FROM a, b), r AS (SELECT *, rank() OVER (PARTITION BY left_id ORDER BY size DESC, size / len(b) DESC) AS k FROM s WHERE size > 0),
o AS (SELECT *, count(*) OVER (PARTITION BY left_id) AS n FROM r WHERE k = 1)"""


@query(f"""WITH a AS (SELECT c_custkey AS left_id, (c_custkey * 7919 % 100003)::VARCHAR AS a FROM customer), b AS (SELECT s_suppkey AS right_id, (s_suppkey * 104729 % 999983)::VARCHAR AS b FROM supplier),
{_FUZZY.format(lcs=_LCS)} SELECT left_id, right_id, size::INT AS size FROM o WHERE n = 1""")
def number_fuzzy_match(spark, d):
    """J8 on numbers of one to six digits: short and long matches, and ties, which leave a row out."""
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % 100003).cast("string").alias("name"))
    return C.fuzzy_match(left, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 104729 % 999983).cast("string").alias("name")))


@query(f"""WITH a AS (SELECT n_nationkey AS left_id, n_name AS a FROM nation WHERE n_nationkey % 2 = 1), b AS (SELECT n_nationkey AS right_id, 'id' || n_name AS b FROM nation WHERE n_nationkey % 2 = 1),
{_FUZZY.format(lcs=_LCS)} SELECT left_id, right_id FROM o WHERE n = 1 UNION ALL SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey % 2 = 0""")
def name_second_degree(spark, d):
    """Half of the names match exactly, the rest by their longest common substring with what is left."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    right = nation.select("id", F.array(F.when(F.col("id") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("id"), "n_name"))).alias("candidates"))
    return C.second_degree(nation.select("id", F.array("n_name").alias("candidates")), right)


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS id_0, n_nationkey AS id_1, CASE WHEN n_nationkey < 20 THEN n_nationkey END AS id_2 FROM nation")
def name_match_all(spark, d):
    """Three lists, matched against the second, which is the longest; names without a partner stay, with null."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array("n_name").alias("candidates"))
    return C.match_all([nation.where("id % 2 = 0"), nation, nation.where("id < 20")])


@query("SELECT n_nationkey AS id_0, n_nationkey AS id_1, n_nationkey AS id_2 FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey < 20")
def name_matched_rows(spark, d):
    """J10 as written: rows with a partner in every list."""
    return C.matched_rows(name_match_all(spark, d))


@query("""SELECT coalesce(a.source, b.source) AS source, n, coalesce(a.total, b.total) AS total, best FROM (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS total FROM documents WHERE source <> 'src1' GROUP BY 1) a
FULL JOIN (SELECT source, max(n_chars)::BIGINT AS best, 0::BIGINT AS total FROM documents WHERE source <> 'src0' GROUP BY 1) b ON a.source = b.source""")
def metric_frames_merged(spark, d):
    """J18, SE8: frames of one key side by side; of a shared column the first value that is there."""
    docs = table(spark, d, "documents")
    a = docs.where("source <> 'src1'").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("total"))
    b = docs.where("source <> 'src0'").groupBy("source").agg(F.max("n_chars").cast("long").alias("best"), F.lit(0).cast("long").alias("total"))
    return E.merge_frames([a, b], ["source"]).select("source", "n", "total", "best")


@query("SELECT lang, max(n_chars) - min(n_chars) AS spread, count(*) FILTER (n_chars > 1000) AS long_texts FROM documents GROUP BY lang")
def custom_rollup(spark, d):
    """AG31."""
    return E.aggregate_frame(table(spark, d, "documents"), ["lang"], {"spread": F.max("n_chars") - F.min("n_chars"), "long_texts": F.count_if(F.col("n_chars") > 1000)})


@query("SELECT * FROM (SELECT 'quality' AS name, count(*) FILTER (quality NOT IN (0, 1)) = 0 AS is_binary FROM labels UNION ALL SELECT 'toxic', count(*) FILTER (toxic NOT IN (0, 1)) = 0 FROM labels UNION ALL SELECT 'doc_id', count(*) FILTER (doc_id NOT IN (0, 1)) = 0 FROM labels)")
def binary_check(spark, d):
    """AG40."""
    labels = table(spark, d, "labels")
    return spark.createDataFrame([(c, M.is_binary(labels, c)) for c in ("quality", "toxic", "doc_id")], "name string, is_binary boolean")


@query(f"""WITH {VOX}, m AS (SELECT vec_id, x, y, z, abs(value) AS s, x + 1.0 AS r FROM vox),
c AS (SELECT vec_id, sum(s*x)/sum(s) AS sx, sum(s*y)/sum(s) AS sy, sum(s*z)/sum(s) AS sz, sum(r*x)/sum(r) AS rx, sum(r*y)/sum(r) AS ry, sum(r*z)/sum(r) AS rz FROM m GROUP BY 1)
SELECT vec_id, round(sqrt(pow((sx-rx)*1,2) + pow((sy-ry)*2,2) + pow((sz-rz)*0.5,2)), 6) AS com_dist FROM c""")
def centre_distance(spark, d):
    """AG42, with voxel sizes that differ by axis."""
    rows = vox(spark, d).withColumn("r", F.col("x") + 1.0).withColumn("s", F.abs("value"))
    return M.centre_distance(rows, K, "s", "r", list(V.AXES), (1.0, 2.0, 0.5)).select("vec_id", F.round("com_dist", 6).alias("com_dist"))


def _linear(at: str, n: int, name: str) -> str:
    """SQL of a table name(o, i, w): the linear weights of old places i for new places o at the positions `at`."""
    low = f"least(greatest(floor({at}), 0), {n - 1})"
    return f"""{name} AS (SELECT o, i, sum(w) AS w FROM (SELECT o, least(greatest(floor(p) + h, 0), {n - 1})::INT AS i, CASE WHEN h = 1 THEN p - floor(p) ELSE 1 - (p - floor(p)) END AS w
FROM (SELECT o, ({at})::DOUBLE AS p FROM range({{to}}) t(o)), (VALUES (0), (1)) u(h)) GROUP BY ALL)"""


def _grid(source: str, old: int, new: int, at: str, name: str = "w") -> str:
    weights = _linear(at, old, name).format(to=new)
    return f"{weights}, out_{name} AS (SELECT vec_id, a.o::INT AS x, b.o::INT AS y, c.o::INT AS z, sum(a.w * b.w * c.w * value) AS value FROM {source} JOIN {name} a ON a.i = x JOIN {name} b ON b.i = y JOIN {name} c ON c.i = z GROUP BY ALL)"


@query(f"WITH {VOX}, {_grid('vox', 4, 6, 'o * 3 / 5.0')} SELECT vec_id, x, y, z, round(value, 5) + 0 AS value FROM out_w")
def vox_zoom_linear(spark, d):
    """F-A18, WS10, RS4 with order 1: from 4 to 6 voxels, corners on corners."""
    return rounded(V.zoom(vox(spark, d), K, SHAPE, (6, 6, 6), 1), 5)


@query(f"""WITH {VOX}, e AS (SELECT vec_id, t.x::INT AS x, u.y::INT AS y, v.z::INT AS z, value FROM vox s, range(4) t(x), range(4) u(y), range(4) v(z)
WHERE s.x = least(greatest(t.x, 1), 2) AND s.y = least(greatest(u.y, 1), 2) AND s.z = least(greatest(v.z, 1), 2)), {_grid('e', 4, 7, 'o / 2.0')} SELECT vec_id, x, y, z, round(value, 5) + 0 AS value FROM out_w""")
def resize_back(spark, d):
    """AG78: a window without its border of 1, edge-padded to its size, zoomed to 7 voxels an axis."""
    return rounded(W.resize_back(vox(spark, d), K, SHAPE, (1, 1, 1), (7, 7, 7)), 5)


@query(f"""WITH {VOX}, n AS (SELECT vec_id, x, y, z, -value AS value FROM vox WHERE x < 3 AND y < 3 AND z < 3), {_grid('n', 3, 4, 'o * 2 / 3.0', 'm')},
{_grid('vox', 4, 6, 'o * 4 / 6.0', 'f')}, {_grid('out_m', 4, 6, 'o * 4 / 6.0', 'g')}
SELECT a.vec_id, a.x, a.y, a.z, round(a.value, 5) + 0 AS fixed, round(b.value, 5) + 0 AS moving FROM out_f a JOIN out_g b USING (vec_id, x, y, z)""")
def pairwise_resize(spark, d):
    """WS20: a moving volume of 3 voxels an axis brought to the fixed one's 4, and both to a window of 6."""
    v = vox(spark, d)
    moving = V.crop(v, {a: 0 for a in V.AXES}, {a: 3 for a in V.AXES}).withColumn("value", -F.col("value"))
    out = P.pairwise_resized(v, moving, K, SHAPE, (3, 3, 3), (6, 6, 6))
    return out.select(*K, *V.AXES, F.round("fixed", 5).alias("fixed"), F.round("moving", 5).alias("moving"))


_MATRIX = V.corner_affine(SHAPE, 0.4, 12)
_AT = ", ".join(f"({row[0]!r} * x + {row[1]!r} * y + {row[2]!r} * z + {row[3]!r})::DOUBLE AS p{a}" for a, row in zip("xyz", _MATRIX, strict=True))


@query(f"""WITH {VOX}, g AS (SELECT vec_id, x, y, z, {_AT} FROM vox), o AS (SELECT unnest([0, 1]) AS o),
c AS (SELECT vec_id, x, y, z, least(greatest(floor(px) + a.o, 0), 3) AS u, least(greatest(floor(py) + b.o, 0), 3) AS v, least(greatest(floor(pz) + c.o, 0), 3) AS t,
 {" * ".join(f"(CASE WHEN {o}.o = 1 THEN p{a} - floor(p{a}) ELSE 1 - (p{a} - floor(p{a})) END)" for o, a in zip("abc", "xyz", strict=True))} AS w FROM g, o a, o b, o c)
SELECT c.vec_id, c.x, c.y, c.z, round(sum(w * value), 5) + 0 AS value FROM c JOIN vox s ON c.vec_id = s.vec_id AND u = s.x AND v = s.y AND t = s.z GROUP BY ALL""")
def affine_augmentation(spark, d):
    """F-A21: the affine of corners drawn inwards (its matrix is tested against a least squares solver), applied linearly."""
    return rounded(V.warped(vox(spark, d), K, SHAPE, _MATRIX), 5)


@query(f"WITH {VOX}, {_grid('vox', 4, 2, 'o * 3.0')} SELECT vec_id, x, y, z, round(value, 5) + 0 AS value FROM out_w")
def random_scaling(spark, d):
    """F-A5 with order 1: a drawn factor of one half (a scaling from -50 to -50 percent), not smoothed before."""
    return rounded(V.rescaled(vox(spark, d), K, SHAPE, V.random_zoom(-50.0, -50.0, 3), 1, antialias=False), 5)


@query(f"WITH {VOX}, f AS (SELECT vec_id, x, y, z, (x * 2 / 3.0 + 0.5)::DOUBLE AS p, value FROM vox) SELECT f.vec_id, f.x, f.y, f.z, round((1 - (p - floor(p))) * a.value + (p - floor(p)) * b.value, 5) + 0 AS value FROM f JOIN vox a ON a.vec_id = f.vec_id AND a.y = f.y AND a.z = f.z AND a.x = least(floor(p), 3) JOIN vox b ON b.vec_id = f.vec_id AND b.y = f.y AND b.z = f.z AND b.x = least(floor(p) + 1, 3)")
def field_warp(spark, d):
    """RS8: a displacement along x given on 2 x 2 x 2 places, 0.5 - x / 3 once zoomed to the volume; none along y and z."""
    v = vox(spark, d)
    coarse = v.where("x < 2 and y < 2 and z < 2")
    field = [coarse.withColumn("value", 0.5 - F.col("x")), coarse.withColumn("value", F.lit(0.0)), coarse.withColumn("value", F.lit(0.0))]
    return rounded(V.field_warped(v, field, K, SHAPE, (2, 2, 2)), 5)


@query(f"WITH {_IMG} SELECT c_custkey, 0 AS x0, 0 AS y0, 0 AS z0, X AS x1, Y AS y1, Z AS z1 FROM img")
def whole_image_windows(spark, d):
    """WS22."""
    return W.whole_image(images(spark, d), "c_custkey")


@query("SELECT * FROM (SELECT 'itself' AS name, true AS same UNION ALL SELECT 'labels', (SELECT count(*) FROM ((SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))) = 0)")
def same_id_sets(spark, d):
    """SE1."""
    docs = table(spark, d, "documents")
    cases = {"itself": C.same_ids(docs, docs.orderBy(F.desc("doc_id")), "doc_id"), "labels": C.same_ids(docs, table(spark, d, "labels"), "doc_id")}
    return spark.createDataFrame(list(cases.items()), "name string, same boolean")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN v > 25 THEN 26 - exp(25 - v) ELSE v END, 6) AS high, round(CASE WHEN v < 25 THEN 24 + exp(v - 25) ELSE v END, 6) AS low, v + v + v AS tiled
FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS v FROM lineitem)""")
def bent_and_tiled(spark, d):
    """F-M3, F-M11."""
    v = F.col("l_quantity").cast("double")
    tiled = F.aggregate(I.tiled(v, 3), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(I.smooth_threshold(v, F.lit(25.0), "high"), 6).alias("high"), F.round(I.smooth_threshold(v, F.lit(25.0), "low"), 6).alias("low"), tiled.alias("tiled"))


_CUT = "SELECT l_returnflag, '{k}' AS kind, round(quantile_cont(l_extendedprice::DOUBLE, {a}), 4) AS low, round(quantile_cont(l_extendedprice::DOUBLE, {b}), 4) AS high FROM lineitem GROUP BY l_returnflag"


@query(" UNION ALL ".join(_CUT.format(k=k, a=a, b=b) for k, a, b in (("percentile", 0.09, 0.91), ("quartile", 0.2, 0.76), ("median", 0.09, 0.91))))
def hist_cutoffs(spark, d):
    """F-M2: cutoffs 0.7 and 0.2, given the wrong way round, as each kind of landmarks standardises them."""
    lines, out = table(spark, d, "lineitem"), None
    for kind in ("percentile", "quartile", "median"):
        marks = I.landmarks(lines, ["l_returnflag"], "l_extendedprice", (0.7, 0.2), kind)
        rows = marks.select("l_returnflag", F.lit(kind).alias("kind"), F.round(F.col("landmarks")[0], 4).alias("low"), F.round(F.col("landmarks")[12], 4).alias("high"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM (SELECT l_orderkey, avg(l_discount)::DOUBLE AS a, max(l_tax)::DOUBLE AS b FROM lineitem GROUP BY 1)")
def batch_mean_losses(spark, d):
    """LO31, AG71: losses of items, averaged over the batch."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").cast("double").alias("a"), F.max("l_tax").cast("double").alias("b"))
    return L.batch_mean(items, "a", "b").select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def _portable(key: str, seed: int) -> str:
    once = f"((({key} * 7919 + {seed})::BIGINT * 1103515245 + 12345) % 2147483648)"
    return f"(({once} * 1103515245 + 12345) % 2147483648)"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_portable('doc_id', 5)}, doc_id) - 1 AS position FROM documents")
def shuffled_subjects(spark, d):
    """SO3: a seeded order of all subjects."""
    return W.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", 5)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY doc_id::HUGEINT * 2147483648 + {_portable('doc_id', 5)}::HUGEINT * 16, doc_id) - 1 AS position FROM documents")
def shuffled_windows(spark, d):
    """SO3: windows shuffled inside a buffer of 16."""
    return W.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", 5, 16, "doc_id")


def _answer(f) -> str:
    """What a rule says: nothing, or the text of its error."""
    try:
        f()
    except ValueError as e:
        return str(e)
    return ""


@query("""SELECT name, coalesce(message, '') AS message FROM (VALUES ('known', NULL), ('near', 'unknown: uniformm; did you mean uniform?'), ('far', 'unknown: something'), ('key', 'unknown: batch_sise; did you mean batch_size?'), ('values', NULL), ('no values', 'empty sections: [''none'']')) t(name, message)""")
def option_hints(spark, d):
    """PF6, PF14, PF15: options, keys and required columns, and what is said where they are wrong."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.lit(None).cast("string").alias("none"))
    samplers = ["uniform", "weighted", "balanced", "grid"]
    rules = {
        "known": lambda: look_up("uniform", samplers), "near": lambda: look_up("uniformm", samplers), "far": lambda: look_up("something", samplers),
        "key": lambda: read_config("[NETWORK]\nbatch_sise = 2"), "values": lambda: C.require_values(docs, ["source"]), "no values": lambda: C.require_values(docs, ["source", "none"]),
    }
    return spark.createDataFrame([(n, _answer(f)) for n, f in rules.items()], "name string, message string")


@query("SELECT doc_id, source FROM documents")
def layers_fitted(spark, d):
    """Codes learnt from a table, applied, and undone."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    layer = Y.label_codes("source").fit(docs)
    return layer.inverse(layer(docs)).select("doc_id", "source")


@query("SELECT vec_id, x, y, z, inferred, reference FROM (SELECT vec_id, (pos // 16)::INT AS x, ((pos // 4) % 4)::INT AS y, (pos % 4)::INT AS z, v::DOUBLE AS inferred, -v::DOUBLE AS reference FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings)) WHERE x < 2")
def aligned_voxels(spark, d):
    """Predictions and labels side by side by voxel; what one side lacks is left out."""
    v = vox(spark, d)
    return R.aligned_voxels(v, v.where("x < 2").withColumn("value", -F.col("value")), "vec_id")
