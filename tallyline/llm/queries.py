"""The queries of the training-data operators, with their production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import byte_bpe, clustering, exact_dedup, filter_audit, language_id, lm_score, near_dedup, packing, quality_rules, token_counts, token_ids, url_filters, warc
from tallyline.llm.common import scratch_path

URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
TOKEN_LIMIT = 1024
BPE_END, WORD_END = 2, 1
SEQUENCE = 2048


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return url_filters.url_filter(pages(spark, sf_dir), rules)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~out))
    found = language_id.predict(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), limit=TOKEN_LIMIT)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged, names = quality_rules.judge(docs.select("doc_id", "text"), rules)
    wanted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(names[n]).alias(n) for n in wanted))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    token_ids.write_token_ids(documents(spark, sf_dir), path, tokenizer("byte_bpe_50k.json"), end_id=BPE_END)
    return token_ids.read_token_ids(spark, path, with_ids=False)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=WORD_END, length=SEQUENCE)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(pages(spark, sf_dir), path)
    return warc.read_warc(spark, path)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(documents(spark, sf_dir), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir)).drop("rid")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).drop("rid")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("scans")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_url_filter, op2_language_id, op3_token_counts, op4_quality_rules, op5_token_ids, op6_packing, op7_warc, op8_byte_bpe,
        op9_exact_dedup, op10_near_dedup, op11_centroid_clustering, op12_filter_audit, op13_lm_score,
    )
    return {f.__name__: f for f in found}


_OP1 = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_host, rule_path, rule_verdict) AS (VALUES %s
), fits AS (
  SELECT s.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
  FROM split s LEFT JOIN rules r
    ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE n = 1
""" % ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_OP7 = """
WITH digests AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hexed FROM pages
), winners AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes, max(page_id) OVER (PARTITION BY hexed) AS response,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hexed, 1 + 5 * (i // 4), 5))::INT >> (5 * (3 - i %% 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM digests
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM winners
""".replace("%%", "%")

_OP9 = r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM texts WINDOW w AS (PARTITION BY text_sha256)
"""




def _op11() -> str:
    """Ten rounds, one after the other; vectors and centroids as rows of (number, component, integer)."""
    steps = [r"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), cells AS MATERIALIZED (
  SELECT rid, unnest(range(64)) AS i, unnest(v) AS x FROM kept
), seeds AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c FROM kept
), c0 AS MATERIALIZED (SELECT c, i, x FROM seeds JOIN cells USING (rid) WHERE c < 8)"""]
    for n in range(11):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT rid, min(c) AS cluster, any_value(least_d) AS distance
  FROM (SELECT *, min(d) OVER (PARTITION BY rid) AS least_d FROM (
    SELECT rid, c, sum((v.x - w.x) * (v.x - w.x))::BIGINT AS d FROM cells v JOIN c{n} w USING (i) GROUP BY rid, c))
  WHERE d = least_d GROUP BY rid)""")
        if n < 10:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c, i, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN (
    SELECT cluster AS c, i, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS x
    FROM (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{n} JOIN cells USING (rid) GROUP BY cluster, i)) m USING (c, i))""")
    return "WITH " + ", ".join(steps) + """, named AS (
  SELECT c AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c10 GROUP BY c
) SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a10 JOIN kept USING (rid) JOIN named USING (cluster)"""


_OP12 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT t.doc_id, part, coalesce(good, false) AS good, coalesce(k.toxic, false) AS toxic,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(min(t.doc_id) OVER (PARTITION BY text) < t.doc_id, false)] AS fails
  FROM texts t LEFT JOIN known k ON k.doc_id = t.doc_id
), patterns AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM flags GROUP BY part, fails
), letters AS (SELECT unnest(range(1, 6)) AS f
), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS p FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (SELECT p, unnest(range(1, 6)) AS step FROM orders
), counted AS (
  SELECT part, p, step, p[step] AS f,
    sum(CASE WHEN NOT list_bool_or(list_transform(p[1:step], lambda i: fails[i])) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails[p[step]] AND NOT coalesce(list_bool_or(list_transform(p[1:step - 1], lambda i: fails[i])), false) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails[p[step]] AND coalesce(list_bool_or(list_transform(p[1:step - 1], lambda i: fails[i])), false) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[p[step]] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails[p[step]] AND NOT coalesce(list_bool_or(list_transform(p[1:step - 1], lambda i: fails[i])), false) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails[p[step]] AND NOT coalesce(list_bool_or(list_transform(p[1:step - 1], lambda i: fails[i])), false) THEN toxic ELSE 0 END) AS toxic_lost
  FROM patterns, steps GROUP BY part, p, step
)
SELECT part, array_to_string(list_transform(p, lambda i: substr('ABCDE', i::INT, 1)), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
""".replace("\\\\", "\\")


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the operator; the others have brute-force tests."""
    return {"op1_url_filter": _OP1, "op7_warc": _OP7, "op9_exact_dedup": _OP9, "op11_centroid_clustering": _op11(), "op12_filter_audit": _OP12}
