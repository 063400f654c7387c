"""Queries over the catalog, names and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import catalog as C
from .registry import query, table

_SPLIT = """
p AS (SELECT doc_id, CASE WHEN rank <= nt THEN 'training' WHEN rank <= nt + nv THEN 'validation' ELSE 'inference' END AS phase
      FROM (SELECT doc_id, row_number() OVER (ORDER BY (doc_id*1103515245+12345)%2147483648, doc_id) AS rank FROM documents),
           (SELECT ceil(count(*)*0.2)::BIGINT AS nv, (count(*) - ceil(count(*)*0.2) - ceil(count(*)*0.1))::BIGINT AS nt FROM documents))
"""


def _sections(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("subject_id"), F.col("source").alias("image"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("subject_id"), F.col("quality").cast("string").alias("label"))
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("subject_id"), F.col("label").cast("string").alias("vector"))
    return docs, labels, vecs


def _partition(spark, d):
    return C.random_split(table(spark, d, "documents"), "doc_id", 0.2, 0.1).withColumnRenamed("doc_id", "subject_id")


@query("""SELECT coalesce(d.doc_id, l.doc_id, vec_id) AS subject_id, source AS image, quality::VARCHAR AS label, label::VARCHAR AS vector
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id FULL JOIN embeddings ON coalesce(d.doc_id, l.doc_id) = vec_id""")
def catalog_outer(spark, d):
    return C.join_sections(list(_sections(spark, d)))


@query(f"WITH {_SPLIT} SELECT doc_id, phase FROM p")
def catalog_split(spark, d):
    return C.random_split(table(spark, d, "documents"), "doc_id", 0.2, 0.1)


@query(f"WITH {_SPLIT} SELECT doc_id AS subject_id, source AS image, phase FROM documents JOIN p USING (doc_id)")
def catalog_phase_join(spark, d):
    return C.with_partition(_sections(spark, d)[0], _partition(spark, d))


@query(f"WITH {_SPLIT} SELECT phase, count(*) AS n FROM documents JOIN p USING (doc_id) GROUP BY phase")
def catalog_phase_counts(spark, d):
    return C.phase_counts(_sections(spark, d)[0], _partition(spark, d))


@query(f"WITH {_SPLIT} SELECT doc_id AS subject_id, source AS image FROM documents JOIN p USING (doc_id) WHERE phase = 'validation'")
def catalog_file_list(spark, d):
    return C.file_list(_sections(spark, d)[0], _partition(spark, d), "validation", ["image"])


@query("SELECT doc_id AS subject_id, source AS image FROM documents")
def catalog_phase_fallback(spark, d):
    """PF3: labels as a partition that has no inference phase, so all subjects come back."""
    partition = table(spark, d, "labels").select(F.col("doc_id").alias("subject_id"), F.lit("training").alias("phase"))
    return C.with_fallback(_sections(spark, d)[0], partition, "inference")


@query("SELECT d.doc_id AS subject_id, source AS image, quality::VARCHAR AS label, e.label::VARCHAR AS vector FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON vec_id = d.doc_id WHERE source <> ''")
def catalog_complete_case(spark, d):
    return C.complete_cases(C.join_sections(list(_sections(spark, d))), ["image", "label", "vector"])


@query("SELECT doc_id AS subject_id, quality::VARCHAR AS label FROM labels WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def catalog_semi(spark, d):
    _, labels, vecs = _sections(spark, d)
    return C.known_only(labels, vecs)


@query("SELECT doc_id AS subject_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def catalog_anti(spark, d):
    docs, labels, _ = _sections(spark, d)
    return C.missing_subjects(docs, labels)


@query("SELECT doc_id AS subject_id, source || '|' || lang AS image FROM documents")
def catalog_grouped_sections(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("subject_id"), "source", "lang")
    return C.grouped_sections(docs, {"image": ["source", "lang"]}).select("subject_id", F.concat_ws("|", "image").alias("image"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def ids_unique_violations(spark, d):
    return C.duplicate_ids(table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT c_name, c_acctbal FROM (SELECT *, count(*) OVER (PARTITION BY round(c_acctbal)) AS n, round(c_acctbal)::BIGINT AS k FROM customer) WHERE n = 1")
def names_without_duplicates(spark, d):
    rows = table(spark, d, "customer").select("c_name", "c_acctbal", F.round("c_acctbal").cast("long").alias("k"))
    return C.without_duplicates(rows, "k").select("c_name", "c_acctbal")


@query("SELECT source, (row_number() OVER (ORDER BY source) - 1)::INT AS code FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def labels_distinct_map(spark, d):
    return C.label_map(table(spark, d, "documents"), "source")


@query("""WITH m AS (SELECT source, (row_number() OVER (ORDER BY source) - 1)::INT AS code FROM (SELECT DISTINCT source FROM documents WHERE source <> 'src0'))
SELECT doc_id, coalesce(code, 0)::INT AS code, m.source AS back FROM documents d LEFT JOIN m USING (source)""")
def labels_relabel(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    mapping = C.label_map(docs.where("source <> 'src0'"), "source")
    coded = C.relabel(docs, "source", mapping, "code")
    known = coded.join(mapping.select("source"), "source", "left_semi")
    other = coded.join(mapping.select("source"), "source", "left_anti")
    return C.unlabel(known, "code", mapping, "back").select("doc_id", "code", "back").unionByName(other.select("doc_id", "code", F.lit(None).cast("string").alias("back")))


@query("SELECT p_partkey, p_name FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size > 20 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def models_updated(spark, d):
    """SE5: a dictionary update in which the second table wins."""
    part = table(spark, d, "part")
    old = part.where("p_size > 20").select("p_partkey", F.col("p_brand").alias("p_name"))
    return C.updated(old, part.where("p_size <= 25").select("p_partkey", "p_name"), "p_partkey")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def ids_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("""WITH a AS (SELECT DISTINCT p_brand AS name FROM part), b AS (SELECT min(p_partkey) AS right_id, p_brand AS name FROM part WHERE p_size > 10 GROUP BY p_brand)
SELECT name AS left_id, right_id, name FROM a JOIN b USING (name)""")
def name_first_degree(spark, d):
    part = table(spark, d, "part")
    left = part.select(F.col("p_brand").alias("id")).distinct().withColumn("candidates", F.array(F.concat(F.lit("x"), "id"), "id"))
    right = part.where("p_size > 10").groupBy("p_brand").agg(F.min("p_partkey").alias("id")).select("id", F.array("p_brand").alias("candidates"))
    return C.first_degree(left, right)


@query("""WITH a AS (SELECT n_nationkey AS left_id, n_name || '_x' AS a FROM nation), b AS (SELECT n_nationkey AS right_id, 'id' || n_name AS b FROM nation),
s AS (SELECT left_id, right_id, b, coalesce((SELECT max(k) FROM (SELECT unnest(range(1, len(a) + 1)) AS i) t, (SELECT unnest(range(1, 40)) AS k) u WHERE i + k - 1 <= len(a) AND contains(b, substr(a, i, k))), 0) AS size FROM a, b),
r AS (SELECT *, rank() OVER (PARTITION BY left_id ORDER BY size DESC, size / len(b) DESC) AS k FROM s WHERE size >= 3),
o AS (SELECT *, count(*) OVER (PARTITION BY left_id) AS n FROM r WHERE k = 1)
SELECT left_id, right_id, size::INT AS size FROM o WHERE n = 1""")
def name_fuzzy_match(spark, d):
    nation = table(spark, d, "nation")
    left = nation.select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit("_x")).alias("name"))
    right = nation.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("id"), "n_name").alias("name"))
    return C.fuzzy_match(left, right)


@query("SELECT page_id, url FROM pages WHERE contains(url, 'http') AND contains(url, 'page=') AND NOT contains(url, '/fr/')")
def url_match(spark, d):
    pages = table(spark, d, "pages")
    return pages.where(S.name_matches(F.col("url"), ["http", "page="], ["/fr/"])).select("page_id", "url")


@query(r"""WITH b AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_replace(url, '[^/]*$', '') AS f FROM pages),
e AS (SELECT *, regexp_extract(name, '(?i)(\.nii\.gz|\.tar\.gz|\.[^.]+)$', 1) AS extension FROM b)
SELECT page_id, CASE WHEN len(f) > 1 AND f[-1] = '/' THEN f[:-2] ELSE f END AS folder, left(name, len(name) - len(extension)) AS base, extension FROM e""")
def url_split(spark, d):
    folder, base, ext = S.split_filename(F.col("url"))
    return table(spark, d, "pages").select("page_id", folder.alias("folder"), base.alias("base"), ext.alias("extension"))


@query(r"""WITH b AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages),
s AS (SELECT page_id, left(name, len(name) - len(regexp_extract(name, '(?i)(\.nii\.gz|\.tar\.gz|\.[^.]+)$', 1))) AS base FROM b),
p AS (SELECT page_id, base, list_filter(list_transform(regexp_split_to_array(base, 'page|ref'), lambda x: regexp_replace(x, '[^0-9A-Za-z_]+', '', 'g')), lambda x: x <> '') AS parts FROM s)
SELECT page_id, array_to_string(CASE WHEN len(parts) > 1 THEN list_append(parts, array_to_string(parts, '')) ELSE parts END, '|') AS candidates, regexp_replace(base, 'page=|ref=', '', 'g') AS removed FROM p""")
def url_subject_id(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat_ws("|", S.subject_ids(F.col("url"), ["page", "ref"])).alias("candidates"), S.remove_from_id(F.col("url"), "page=|ref=").alias("removed"))


@query("""SELECT a.n_name AS a, b.n_name AS b, damerau_levenshtein(a.n_name, b.n_name)::INT AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def name_edit_distance(spark, d):
    n = table(spark, d, "nation")
    pairs = n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey")
    return pairs.select("a", "b", S.damerau_levenshtein(F.col("a"), F.col("b")).alias("distance"))


@query(r"""SELECT page_id, regexp_replace(trim(url), '[^0-9a-zA-Z_\- ]+', '', 'g') AS name, page_id + 2.5::DOUBLE AS numbers, page_id % 2 = 0 AS flag FROM pages""")
def config_strings(spark, d):
    pages = table(spark, d, "pages")
    numbers = S.parse_array(F.concat(F.lit("("), F.col("page_id").cast("string"), F.lit(", 2.5)")), "double")
    flag = S.parse_bool(F.when(F.col("page_id") % 2 == 0, "Yes").otherwise("FALSE"))
    return pages.select("page_id", S.standard_name(F.col("url")).alias("name"), (numbers[0] + numbers[1]).alias("numbers"), flag.alias("flag"))
