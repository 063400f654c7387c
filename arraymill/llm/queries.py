"""The numbered queries over the whole tables, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(fold: int, name: str = "doc_id"):
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(fold)) == 0


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_scores

    scored = lm_scores(table(spark, sf_dir, "documents"), train=~held_out(10), order=3)
    return scored.select("doc_id", held_out(10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train_on=~held_out(5, "__id"))
    return scored.withColumn("held_out", held_out(5)).select("doc_id", "held_out", "score", "predicted")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), radius=2, shingle=3, seed=42)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), size=200).drop("kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages"), least_bytes=100)


OP8_SQL = """
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> m THEN m END AS refers_to
FROM (SELECT page_id, octet_length(encode(t)) AS n, sha256(t) AS d, min(page_id) OVER (PARTITION BY t) AS m
      FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)


_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_LOWER_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, l, w[s:s+l-1] AS g
       FROM (SELECT item_id, w, least(len(w), 13) AS l, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT doc_id, s, l, w[s:s+l-1] AS g
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, ls WHERE len(w) >= l)),
m AS (SELECT doc_id, s, l, item_id FROM dw JOIN iw USING (l, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import dataset_manifest

    return dataset_manifest(table(spark, sf_dir, "documents"), tamper=held_out(7))


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string in DuckDB: one list entry for each bit, the byte enters at the first of its eight."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({f})::VARCHAR)) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


OP11_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n,
         {_leaf_sql("n_chars")} AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS changed
  FROM documents),
t AS (SELECT coalesce('=' || lang, '') AS k, 0 AS l, r, n, leaf AS d FROM leaf
      UNION ALL SELECT k, l + 1, r // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY r)) FROM t WHERE n > 1 GROUP BY k, l, r // 2, n),
s AS (SELECT k, d AS subroot, l AS h, row_number() OVER (ORDER BY k) - 1 AS r, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS l, r, n, subroot AS d FROM s
      UNION ALL SELECT l + 1, r // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY r)) FROM u WHERE n > 1 GROUP BY l, r // 2, n),
p AS (SELECT k, l, r, lag(d) OVER w AS b, lead(d) OVER w AS a FROM t WHERE n > 1 WINDOW w AS (PARTITION BY k, l, r // 2 ORDER BY r)
      UNION ALL SELECT s.k, h + u.l, NULL, CASE WHEN (s.r >> u.l) % 2 = 1 THEN v.d END, CASE WHEN (s.r >> u.l) % 2 = 0 THEN v.d END
      FROM s JOIN u ON u.r = s.r >> u.l AND u.n > 1 LEFT JOIN u AS v ON v.l = u.l AND v.r = xor(u.r, 1)),
x AS (SELECT doc_id, p.l, p.b, p.a FROM leaf JOIN p ON p.k = coalesce('=' || lang, '') AND coalesce(p.r = leaf.r >> p.l, true)),
f AS (SELECT doc_id, 0 AS l, changed AS d FROM leaf
      UNION ALL SELECT f.doc_id, f.l + 1, sha256(coalesce(x.b, '') || f.d || coalesce(x.a, '')) FROM f JOIN x ON x.doc_id = f.doc_id AND x.l = f.l),
q AS (SELECT doc_id, string_agg(coalesce(b, '') || coalesce(a, ''), '' ORDER BY l) AS proof FROM x GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaf JOIN s ON s.k = coalesce('=' || lang, '') JOIN (SELECT doc_id, arg_max(d, l) AS folded FROM f GROUP BY doc_id) USING (doc_id)
LEFT JOIN q USING (doc_id), (SELECT d AS root FROM u WHERE n = 1)
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, repair

    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations)


def _edit(entry: str, cost: str, letter: str) -> str:
    """An entry of the repair, nine digits of cost and the audit, with an edit; null where there is none."""
    return f"lpad((left({entry}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({entry}, 10) || {letter}"


def _inserted(state: int) -> str:
    """The entry of a state after any number of inserts."""
    from_ = {2: [0, 1, 3], 3: [2]}.get(state, [])
    twice = {3: [0, 1], 2: []}.get(state, [])
    parts = [f"s{state}", *[_edit(f"s{i}", "3", "'I'") for i in from_], *[_edit(f"s{i}", "6", "'II'") for i in twice]]
    return f"least({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _put(entry: str, head: str) -> str:
    """The entry of a row that is put out with this initial."""
    kept, given = _edit(entry, "extra", "'K'"), "NULL" if head == "s" else _edit(entry, "3 + extra", "'R'")
    return f"CASE WHEN gone THEN NULL WHEN head = '{head}' THEN {kept} ELSE {given} END"


OP12_SQL = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS code FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c WHERE code <> 0),
h AS (SELECT *, sha256(octet_length(encode(role)) || ':' || role || text) AS digest, left(role, 1) AS head,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, copy) AS i,
    body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS dup FROM h),
f AS (SELECT *, blank OR dup AS gone, NOT (blank OR dup) AND right(body, 1) NOT IN ('.', '!', '?') AS open,
    CASE WHEN NOT (blank OR dup) AND right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS extra,
    lag(head) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM k),
r AS (SELECT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM (SELECT DISTINCT conv_id FROM f)
    UNION ALL
    SELECT conv_id, i, {_edit("p0", "4", "'D'")}, least({_edit("p1", "4", "'D'")}, {_put("p0", "s")}),
           least({_edit("p2", "4", "'D'")}, {_put("p0", "u")}, {_put("p1", "u")}, {_put("p3", "u")}), least({_edit("p3", "4", "'D'")}, {_put("p2", "a")})
    FROM (SELECT f.conv_id, f.i, head, gone, extra, s0 AS p0, s1 AS p1, {_inserted(2)} AS p2, {_inserted(3)} AS p3
          FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1)),
n AS (SELECT conv_id, max(i) AS i, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
    count(*) FILTER (open) AS truncated, count(*) FILTER (before || head NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
b AS (SELECT n.*, least(s0, {_inserted(3)}) AS best FROM n JOIN r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.i),
l AS (SELECT conv_id, p, substr(best, 9 + p, 1) AS letter FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS p FROM b)),
o AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS m FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
q AS (SELECT o.conv_id, p, letter, m, CASE WHEN letter <> 'I' THEN f.role END AS role, CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text
    FROM o LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i WHERE letter <> 'D'),
t AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (m + system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS d
    FROM (SELECT *, max(CASE WHEN m = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM q) GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(d, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), size=50, keep_text=False)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, s, sha256(array_to_string(w[s:s+49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d)),
m AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS first FROM s) WHERE first < doc_id),
h AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM m),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t
      FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN h USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id) USING (doc_id)
"""


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_token_files": op5_token_files,
    "op6_bpe": op6_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op8_warc": OP8_SQL, "op9_decontamination": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_substring_dedup": OP13_SQL}
