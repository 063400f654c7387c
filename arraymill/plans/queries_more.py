"""Queries over pairs, codes and the operators with a numeric core."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import splines as Z
from ..plans import layers as Y
from .queries_volume import SHAPE, VOX, K, rounded, vox
from .queries_windows import _IMG, _u, images
from .registry import query, table


@query("SELECT a.doc_id, a.lang, b.quality AS quality_moving FROM documents a JOIN labels b USING (doc_id)")
def pairwise_readers(spark, d):
    return P.pairwise(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT d.doc_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def windows_with_labels(spark, d):
    return P.with_side_table(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), "doc_id")


@query("""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY ((doc_id * 7919 + 3) * 1103515245 + 12345) % 2147483648, doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b ON b.r = a.r % a.n + 1""")
def self_pairs(spark, d):
    return P.self_pairs(table(spark, d, "documents"), "doc_id", 3)


@query("SELECT doc_id, source, (dense_rank() OVER (ORDER BY source) - 1)::INT AS code FROM documents")
def categorical_codes(spark, d):
    return P.categorical(table(spark, d, "documents").select("doc_id", "source"), "source")


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings")
def reader_positions(spark, d):
    return P.fetched(table(spark, d, "embeddings").select("vec_id"), "vec_id")


_PAIRWISE_WINDOWS_SQL = f"""WITH {_IMG}, s AS (SELECT c_custkey, draw::INT AS draw, ({_u('c_custkey', 'draw', 0, 9)} % (X - 3))::INT AS x0, ({_u('c_custkey', 'draw', 1, 9)} % (Y - 3))::INT AS y0, ({_u('c_custkey', 'draw', 2, 9)} % (Z - 3))::INT AS z0
FROM (SELECT img.*, unnest(range(2)) AS draw FROM img WHERE c_custkey IN (SELECT o_custkey FROM orders)) r) SELECT *, x0 + 4 AS x1, y0 + 4 AS y1, z0 + 4 AS z1 FROM s"""


@query(_PAIRWISE_WINDOWS_SQL)
@query(_PAIRWISE_WINDOWS_SQL, name="pairwise_windows")
def pairwise_windows_all(spark, d):
    """Every customer with an order has a second section."""
    a = images(spark, d)
    ordered = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return P.pairwise_windows(a, a.join(ordered, "c_custkey", "left_semi"), "c_custkey", (4, 4, 4), 2, 9)


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS v FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A')
SELECT k, CASE WHEN min(v) = max(v) THEN min(v) END AS v, min(v) <> max(v) AS conflict FROM r GROUP BY k""")
def constraint_intersection(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v"), "l_returnflag")
    return P.constraints([lines.where("l_returnflag = 'A'"), lines.where("l_returnflag <> 'A'")], "k", "v")


@query(f"WITH {VOX} SELECT vec_id, x, y, z, round(value, 6) AS value FROM vox")
def layers_roundtrip(spark, d):
    """Padding, two flips, and all of it undone."""
    plan = Y.padding(K, SHAPE, (1, 1, 1), "edge").then(Y.flipping((6, 6, 6), (0, 2))).then(Y.seeded_flip((6, 6, 6), 0.5, 11, "vec_id"))
    return rounded(plan.inverse(plan(vox(spark, d))))


_HALVES = """(VALUES (0, 0, 1.0), (1, 0, 0.6), (1, 1, 0.475), (1, 2, -0.1), (1, 3, 0.025), (2, 1, 1.0), (3, 0, -0.125), (3, 1, 0.625), (3, 2, 0.625), (3, 3, -0.125),
(4, 2, 1.0), (5, 0, 0.025), (5, 1, -0.1), (5, 2, 0.475), (5, 3, 0.6), (6, 3, 1.0)) t(o, i, w)"""


_VOX_ZOOM_CUBIC_SQL = f"""WITH {VOX}, h AS (SELECT o::INT AS o, i::INT AS i, w::DOUBLE AS w FROM {_HALVES})
SELECT vec_id, a.o AS x, b.o AS y, c.o AS z, round(sum(a.w * b.w * c.w * value), 6) AS value FROM vox JOIN h a ON a.i = x JOIN h b ON b.i = y JOIN h c ON c.i = z GROUP BY vec_id, a.o, b.o, c.o"""


@query(_VOX_ZOOM_CUBIC_SQL)
@query(_VOX_ZOOM_CUBIC_SQL, name="vox_zoom_cubic")
def vox_zoom_cubic_all(spark, d):
    """All 343 voxels of the zoom from 4 to 7; the SQL has the exact weights of the mirrored spline at knots and halves."""
    return rounded(Z.zoom_cubic(vox(spark, d), K, SHAPE, (7, 7, 7)))


@query(f"WITH {VOX} SELECT vec_id, x, y, z, round(value, 6) AS value FROM vox", name="vox_elastic_identity")
def vox_elastic_identity(spark, d):
    return rounded(Z.elastic(vox(spark, d), K, SHAPE, 4, 0.0))


@query()
def vox_crf_exact(spark, d):
    return rounded(Z.crf(vox(spark, d), K, SHAPE))
