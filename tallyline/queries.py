"""Registered queries of the reconciliation engine and their DuckDB SQL.

The right side of a comparison is a deterministic perturbation of the same table; oracles state the same rules in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline import taxonomy as tx
from tallyline.functions import hashing, identifiers, numbers, values
from tallyline.functions.canon import canon, canon_columns
from tallyline.functions.text import text_token
from tallyline.operators import compare, identity, merkle, profile, reporting, scope, staging, tabs, tree
from tallyline.operators.staging import Snapshot
from tallyline.plans import layered, planner
from tallyline.plans.contract import Contract, spec_version
from tallyline.registry import ORACLES, QUERIES, query, table
from tallyline.sources import listings, state
from tallyline.sources.scratch import spread, store
from tallyline.streaming import replay

CUSTOMER = (
    Contract("custkey", "number", column="c_custkey", scale=0, is_key=True),
    Contract("name", "text", column="c_name", ascii_only=True),
    Contract("nation", "number", column="c_nationkey", scale=0),
    Contract("balance", "money", column="c_acctbal", scale=2),
    Contract("segment", "text", column="c_mktsegment", ascii_only=True),
)
NOW = datetime(2026, 1, 15, tzinfo=timezone.utc)
UID = "tree/0"
#: Rows that a task stages: a row takes some 0.1 ms.
STAGE_ROWS = 20_000

def perturbed(customers: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    balance = F.col("c_acctbal").cast("decimal(38,2)")
    return customers.where(k % 97 != 0).select(
        F.when(k % 101 == 0, k + 1_000_000).otherwise(k).alias("c_custkey"), "c_name", "c_nationkey",
        F.when(k % 89 == 0, balance + 1).otherwise(balance).cast("decimal(38,2)").alias("c_acctbal"),
        F.when(k % 83 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )


_PERTURBED = """r AS (
  SELECT CASE WHEN c_custkey % 101 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS k, c_name AS name, c_nationkey AS nation,
         c_acctbal::DECIMAL(38,2) + CASE WHEN c_custkey % 89 = 0 THEN 1 ELSE 0 END AS balance,
         CASE WHEN c_custkey % 83 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment
  FROM customer WHERE c_custkey % 97 <> 0
), l AS (
  SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation, c_acctbal::DECIMAL(38,2) AS balance, c_mktsegment AS segment FROM customer
)"""
_FIELDS = f"""{_PERTURBED}, pairs AS (
  SELECT l.k, l.balance AS lb, r.balance AS rb, l.segment AS ls, r.segment AS rs FROM l JOIN r USING (k)
), diffs AS (
  SELECT k, 'balance' AS field, 'substantive' AS delta_class FROM pairs WHERE lb <> rb
  UNION ALL SELECT k, 'segment', CASE WHEN lower(ls) = lower(rs) THEN 'cosmetic' ELSE 'substantive' END FROM pairs WHERE ls <> rs
)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, Snapshot]:
    """Customers as the source and their perturbed copy as the target, staged under one contract."""
    customers = spread(table(spark, sf_dir, "customer"), STAGE_ROWS, "c_custkey")
    left = staging.stage(customers, CUSTOMER, keep=["c_custkey"], ascii_only=True)
    right = staging.stage(perturbed(customers), CUSTOMER, side="target", keep=["c_custkey"], ascii_only=True)
    return Snapshot(left, CUSTOMER, UID), Snapshot(right, CUSTOMER, UID)


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    narrow = lambda s: s.rows.select("key", "c_custkey", "canon", "h_row")
    return compare.keyed_comparison(narrow(left), narrow(right))


@query(f"""WITH {_FIELDS}, per_key AS (
  SELECT k, max(delta_class) AS c FROM diffs GROUP BY k
), found AS (
  SELECT coalesce(p.c, 'equal') AS outcome FROM pairs LEFT JOIN per_key p USING (k)
  UNION ALL SELECT 'missing_in_target' FROM l ANTI JOIN r USING (k)
  UNION ALL SELECT 'missing_in_source' FROM r ANTI JOIN l USING (k)
) SELECT outcome, count(*) AS n FROM found GROUP BY outcome""")
def verify_customers(spark, sf_dir):
    left, right = (store(s.rows.select("key", "canon", "h_row"), "side") for s in sides(spark, sf_dir))
    return compare.outcomes(left, right, CUSTOMER)


@query(f"""WITH {_FIELDS}
SELECT k AS custkey, field, delta_class FROM diffs""")
def field_mismatch(spark, sf_dir):
    both = comparison(spark, sf_dir).where(F.col("status") == "matched").withColumn("custkey", F.col("l.c_custkey"))
    return compare.field_differences(both, CUSTOMER, keep=("custkey",)).select("custkey", "field", "delta_class")


@query(f"""WITH {_FIELDS}, all_found AS (
  SELECT 'field_mismatch' AS finding FROM diffs
  UNION ALL SELECT 'missing_in_target' FROM l ANTI JOIN r USING (k) UNION ALL SELECT 'missing_in_source' FROM r ANTI JOIN l USING (k)
) SELECT finding, 'warning' AS severity, count(*) AS n FROM all_found GROUP BY finding""")
def finding_rollup(spark, sf_dir):
    return reporting.rollup(compare.findings(comparison(spark, sf_dir), CUSTOMER))


@query(f"""WITH {_FIELDS}
SELECT (SELECT count(*) FROM diffs) + (SELECT count(*) FROM l ANTI JOIN r USING (k)) + (SELECT count(*) FROM r ANTI JOIN l USING (k)) AS drift_count,
       0::BIGINT AS data_quality_count, 0::BIGINT AS structural_count, 'drift' AS result""")
def verify_summary(spark, sf_dir):
    left, right = (store(s.rows.select("key", "canon", "h_row"), "side") for s in sides(spark, sf_dir))
    return compare.summary(compare.findings(compare.unequal_comparison(left, right), CUSTOMER))


@query(f"""WITH {_FIELDS}
SELECT 'missing_in_source' AS finding, k AS custkey FROM r ANTI JOIN l USING (k) ORDER BY custkey LIMIT 100""")
def top_findings(spark, sf_dir):
    both = comparison(spark, sf_dir).where(F.col("status") == "missing_in_source")
    found = compare.classified(both.select(F.col("status").alias("finding"), F.col("r.c_custkey").alias("custkey")))
    return reporting.top(found, ["custkey"], 100).select("finding", "custkey")


_SPEC = spec_version(CUSTOMER)
_JCS = """'{"balance":"n:' || balance::DECIMAL(38,2) || '","custkey":"n:' || k || '","name":"s:' || name || '","nation":"n:' || nation || '","segment":"s:' || segment || '"}'"""
_HASHED = f"""hashed AS (
  SELECT k, substr(sha256(encode('gos1/row') || '\\x00'::BLOB || encode('{_SPEC}') || '\\x00'::BLOB || encode({_JCS})), 1, 32) AS h,
         unhex(lpad(hex(length('n:' || k)), 8, '0')) || encode('n:' || k) AS key FROM %s
)"""
_KEYED = """keyed AS (SELECT *, ('0x' || substr(sha256(encode('gos1/bkt') || '\\x00'::BLOB || key), 3, 2))::INT AS bucket FROM hashed)"""
_KEYED = _KEYED.replace("\\\\", "\\")
_HASHED = _HASHED.replace("\\\\", "\\")


def _digests(name: str) -> str:
    """SQL of all bucket digests of a side (keys are shorter than 128 bytes)."""
    varint = "CASE WHEN n < 128 THEN lpad(hex(n), 2, '0') ELSE lpad(hex((n & 127) | 128), 2, '0') || lpad(hex(n >> 7), 2, '0') END"
    index = "CASE WHEN b < 128 THEN lpad(hex(b), 2, '0') ELSE lpad(hex((b & 127) | 128), 2, '0') || lpad(hex(b >> 7), 2, '0') END"
    return f"""{_HASHED % name}, {_KEYED}, bodies AS (
      SELECT bucket, count(*) AS n, string_agg(lpad(hex(octet_length(key)), 2, '0') || hex(key) || upper(h), '' ORDER BY key) AS body FROM keyed GROUP BY bucket
    ), every AS (
      SELECT b::INT AS bucket, coalesce(n, 0) AS n, coalesce(body, '') AS body, b FROM range(256) x(b) LEFT JOIN bodies ON bucket = b
    ), digests AS (
      SELECT bucket, n, substr(sha256(encode('gos1/bkt') || '\\x00'::BLOB || unhex({index}) || unhex({varint}) || unhex(body)), 1, 32) AS digest FROM every
    )"""


@query(f"WITH {_PERTURBED}, {_HASHED % 'l'} SELECT k AS custkey, h AS h_row FROM hashed")
def row_hash(spark, sf_dir):
    left, _ = sides(spark, sf_dir)
    return left.rows.select(F.col("c_custkey").alias("custkey"), "h_row")


@query(f"WITH {_PERTURBED}, {_HASHED % 'l'}, {_KEYED} SELECT k AS custkey, lower(hex(key)) AS key, bucket FROM keyed")
def identity_bucket(spark, sf_dir):
    left, _ = sides(spark, sf_dir)
    return left.rows.select(F.col("c_custkey").alias("custkey"), F.lower(F.hex("key")).alias("key"), "bucket")


@query(f"WITH {_PERTURBED}, {_digests('l')} SELECT bucket, n, digest FROM digests")
def bucket_digest(spark, sf_dir):
    return layered.bucket_table(sides(spark, sf_dir)[0])


@query(f"""WITH {_PERTURBED}, {_digests('l')}
SELECT sum(n)::BIGINT AS n, sha256(encode('gos1/ds') || '\\x00'::BLOB || encode('{_SPEC}') || '\\x00'::BLOB || encode('{UID}') || '\\x00'::BLOB
  || unhex((SELECT CASE WHEN t < 128 THEN lpad(hex(t), 2, '0') WHEN t < 16384 THEN lpad(hex((t & 127) | 128), 2, '0') || lpad(hex(t >> 7), 2, '0')
     ELSE lpad(hex((t & 127) | 128), 2, '0') || lpad(hex(((t >> 7) & 127) | 128), 2, '0') || lpad(hex(t >> 14), 2, '0') END FROM (SELECT sum(n)::BIGINT AS t FROM digests)))
  || unhex(string_agg(digest, '' ORDER BY bucket))) AS digest FROM digests""")
def dataset_digest(spark, sf_dir):
    left, _ = sides(spark, sf_dir)
    return merkle.dataset_digest(layered.bucket_table(left), left.spec_version, UID)


@query(f"""WITH {_PERTURBED}, lb AS (WITH {_digests('l')} SELECT * FROM digests), rb AS (WITH {_digests('r')} SELECT * FROM digests)
SELECT lb.bucket FROM lb JOIN rb USING (bucket) WHERE lb.digest <> rb.digest""")
def bucket_diff(spark, sf_dir):
    return merkle.diff_buckets(*map(layered.bucket_table, sides(spark, sf_dir)))


@query(f"""WITH {_FIELDS} SELECT (SELECT count(*) FROM diffs) + (SELECT count(*) FROM l ANTI JOIN r USING (k)) + (SELECT count(*) FROM r ANTI JOIN l USING (k)) AS drift_count,
  0::BIGINT AS data_quality_count, 0::BIGINT AS structural_count, 'drift' AS result, 'rows' AS mode""")
def layered_verification(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    v = layered.verify(left, right)
    return compare.summary(v.findings).withColumn("mode", F.lit(v.mode))


@query(r"""SELECT doc_id, lang_token, sha256(CASE WHEN body = '' THEN 'z:' ELSE 's:' || body END) AS token_sha256 FROM (
  SELECT doc_id, coalesce('s:' || lang, 'z:') AS lang_token,
    regexp_replace(regexp_replace(nfc_normalize(regexp_replace(regexp_replace(regexp_replace(text,
      '[\p{Cf}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n?', chr(10), 'g'), '[\p{Zs}\t]', ' ', 'g')), '^[ \n]+|[ \n]+$', '', 'g'), ' +', ' ', 'g') AS body
  FROM documents)""")
def canon_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text_token(F.col("lang")).alias("lang_token"), F.sha2(text_token(F.col("text")), 256).alias("token_sha256"))


@query("""SELECT p_partkey, 'n:' || p_retailprice::DECIMAL(18,2)::DECIMAL(18,2) AS price, 'n:' || p_size || '.000' AS size,
  CASE WHEN p_size % 3 = 0 THEN 'n:-' || p_size || '234.50' WHEN p_size % 3 = 1 THEN 'n:' || p_size || '234.00' ELSE 'e:NOT_A_NUMBER' END AS written FROM part""")
def canon_number(spark, sf_dir):
    n = F.col("p_size").cast("string")
    written = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("($ "), n, F.lit(",234.495)"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("USD "), n, F.lit(",234"))).otherwise(F.concat(n, F.lit("%")))
    part = table(spark, sf_dir, "part").withColumn("written", written)
    c = Contract("x", "money", scale=2)
    return part.select(
        "p_partkey", canon(F.col("p_retailprice"), c, dtype="double").alias("price"), canon(F.col("p_size"), Contract("x", "number", scale=3), dtype="int").alias("size"), canon(F.col("written"), c).alias("written")
    )


@query("""SELECT doc_id, 'b:' || quality AS quality, CASE doc_id % 4 WHEN 0 THEN 'b:1' WHEN 1 THEN 'b:0' WHEN 2 THEN 'e:BAD_BOOL' ELSE 'b:0' END AS word FROM labels""")
def canon_bool(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, (" Yes", "N", "maybe", " "))), (F.col("doc_id") % 4 + 1).cast("int"))
    c = Contract("x", "bool")
    return table(spark, sf_dir, "labels").select("doc_id", canon(F.col("quality"), c, dtype="int").alias("quality"), canon(words, c).alias("word"))


@query("""SELECT o_orderkey, 'd:' || strftime(o_orderdate, '%Y-%m-%d') AS day, 'd:' || strftime(o_orderdate, '%Y-%m-%d') AS parsed,
  't:' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at_target, 't:' || strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS at_source FROM orders""")
def canon_date(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    c, t = Contract("x", "date", date_formats=("%m/%d/%Y",)), Contract("x", "datetime", timezone="Etc/GMT+8")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return orders.select(
        "o_orderkey", canon(F.col("o_orderdate"), c, dtype="timestamp").alias("day"), canon(F.date_format(at, "M/d/yyyy"), c).alias("parsed"),
        canon(at, t, "target", "timestamp_ntz").alias("at_target"), canon(at, t, "source", "timestamp_ntz").alias("at_source"),
    )


@query("""SELECT event_id, 'd:' || strftime(DATE '1899-12-30' + (event_id % 60000)::INT, '%Y-%m-%d') AS day,
  strftime(TIMESTAMP '1899-12-30' + to_days((event_id % 60000)::INT) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS noon FROM events""")
def serial_dates(spark, sf_dir):
    serial = (F.col("event_id") % 60000).cast("double")
    noon = F.date_format(values.serial_timestamp(serial + F.lit(0.499999999996)), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", canon(serial, Contract("x", "date"), dtype="double").alias("day"), noon.alias("noon"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'k:done' WHEN 'O' THEN 'k:open' ELSE 'e:UNRESOLVED_SELECTION' END AS status FROM orders""")
def canon_selection(spark, sf_dir):
    c = Contract("x", "selection", value_map={"f": "done", "O": "open"}, ascii_only=True)
    return table(spark, sf_dir, "orders").select("o_orderkey", canon(F.col("o_orderstatus"), c).alias("status"))


@query("""SELECT o_custkey, 'r:[' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || ']' AS orders FROM orders GROUP BY o_custkey""")
def canon_relations(spark, sf_dir):
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ",").alias("members"))
    return grouped.select("o_custkey", canon(F.col("members"), Contract("x", "m2m", ascii_only=True)).alias("orders"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'p_type' WHEN p_partkey % 7 = 0 THEN 'p_name' END AS quarantine_field,
  CASE WHEN p_partkey % 5 = 0 THEN 'not_a_number' WHEN p_partkey % 7 = 0 THEN 'missing_required' END AS quarantine_reason FROM part""")
def quarantine_rows(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 5 == 0, F.col("p_type")).otherwise(F.lit("1")).alias("p_type"), F.when(k % 7 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("p_name"))
    columns = (Contract("p_type", "number"), Contract("p_name", "text", required=True, ascii_only=True))
    return staging.stage(part, columns, keep=["p_partkey"], extra=False, ascii_only=True).select("p_partkey", "quarantine_field", "quarantine_reason")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n_identity FROM events""")
def duplicate_identity(spark, sf_dir):
    columns = (Contract("user_id", "number", scale=0, is_key=True), Contract("event_type", "text", is_key=True, ascii_only=True, sequence=20))
    rows = staging.stage(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), columns, keep=["event_id"], extra=False, ascii_only=True)
    return staging.flag_duplicates(rows).select("event_id", "n_identity")


@query("""SELECT 'c_custkey' AS "column", count(c_custkey) AS nonempty, count(DISTINCT c_custkey) AS "distinct" FROM customer
UNION ALL SELECT 'c_name', count(c_name), count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(DISTINCT c_nationkey) FROM customer
UNION ALL SELECT 'c_acctbal', count(c_acctbal), count(DISTINCT c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer""")
def column_profile(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "customer")).select("column", "nonempty", "distinct")


@query("""WITH x AS (SELECT sum(l_quantity::VARCHAR::DECIMAL(38,18)) AS q, sum(l_extendedprice::VARCHAR::DECIMAL(38,18)) AS p,
  sum(CASE WHEN l_orderkey % 97 <> 0 THEN l_quantity::VARCHAR::DECIMAL(38,18) END) AS rq, sum(CASE WHEN l_orderkey % 97 <> 0 THEN l_extendedprice::VARCHAR::DECIMAL(38,18) END) AS rp FROM lineitem)
SELECT 'l_quantity' AS "column", q::DECIMAL(38,18)::VARCHAR AS source_total, rq::DECIMAL(38,18)::VARCHAR AS target_total, (q - rq)::DECIMAL(38,18)::VARCHAR AS difference FROM x
UNION ALL SELECT 'l_extendedprice', p::DECIMAL(38,18)::VARCHAR, rp::DECIMAL(38,18)::VARCHAR, (p - rp)::DECIMAL(38,18)::VARCHAR FROM x""")
def control_totals(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    totals = compare.control_totals(items, items.where(F.col("l_orderkey") % 97 != 0), ["l_quantity", "l_extendedprice"])
    return totals.select("column", *(F.col(c).cast("string").alias(c) for c in totals.columns[1:]))


def _order_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders with sync ids on two of three rows; the target has moved keys, lost ids and doubled keys."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    left = orders.select(k.alias("lid"), F.when(k % 3 != 0, F.concat(F.lit("S"), k.cast("string"))).alias("sync_id"), F.concat(F.lit("K"), k.cast("string")).alias("natural_key"))
    right = orders.where(k % 11 != 0).select(
        k.alias("rid"), F.when((k % 3 != 0) & (k % 5 != 0), F.concat(F.lit("S"), k.cast("string"))).alias("sync_id"),
        F.concat(F.lit("K"), F.when(k % 13 == 0, -k).otherwise(k).cast("string")).alias("natural_key"),
    )
    twins = orders.where(k % 15 == 0).select((k + 10_000_000).alias("rid"), F.lit(None).cast("string").alias("sync_id"), F.concat(F.lit("K"), k.cast("string")).alias("natural_key"))
    return left, right.unionByName(twins)


_ORDER_SIDES = """l AS (SELECT o_orderkey AS lid, CASE WHEN o_orderkey % 3 <> 0 THEN 'S' || o_orderkey END AS sync_id, 'K' || o_orderkey AS key FROM orders
), r AS (SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN 'S' || o_orderkey END AS sync_id,
    'K' || CASE WHEN o_orderkey % 13 = 0 THEN -o_orderkey ELSE o_orderkey END AS key FROM orders WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT o_orderkey + 10000000, NULL, 'K' || o_orderkey FROM orders WHERE o_orderkey % 15 = 0
), first AS (SELECT lid, rid FROM l JOIN r USING (sync_id)
), l1 AS (SELECT * FROM l WHERE lid NOT IN (SELECT lid FROM first)), r1 AS (SELECT * FROM r WHERE rid NOT IN (SELECT rid FROM first)
), k AS (SELECT key, count(*) AS n FROM r1 GROUP BY key
), out AS (
  SELECT 'matched_sync_id' AS outcome FROM first
  UNION ALL SELECT CASE WHEN n = 1 THEN 'matched_key' WHEN n > 1 THEN 'multi_match' ELSE 'unmatched_source' END FROM l1 LEFT JOIN k USING (key)
  UNION ALL SELECT 'unmatched_target' FROM r1 ANTI JOIN l1 USING (key))"""


@query(f"WITH {_ORDER_SIDES} SELECT outcome, count(*) AS n FROM out GROUP BY outcome")
def identity_cascade(spark, sf_dir):
    return identity.cascade(*_order_sides(spark, sf_dir)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN 'z:' ELSE 'r:' || n_name END AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey <> 7""")
def reference_resolution(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where(F.col("n_nationkey") != 7)
    found = identity.resolve_references(table(spark, sf_dir, "customer"), "c_nationkey", nations, "n_nationkey", "n_name", "nation_key")
    return found.select("c_custkey", canon(F.col("nation_key"), Contract("x", "many2one", ascii_only=True)).alias("nation"))


@query("""SELECT c_custkey AS res_id, CASE WHEN c_custkey % 97 = 0 OR c_custkey % 10 = 3 THEN 'unmanaged' ELSE 'linked' END AS state FROM customer""")
def ownership_check(spark, sf_dir):
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    links = customers.select(k.alias("res_id"), F.concat(F.lit("S"), k.cast("string")).alias("sync_id"), F.lit(UID).alias("dataset"), F.when(k % 7 == 0, F.lit("unmanaged")).otherwise(F.lit("linked")).alias("state"))
    target = customers.where(k % 97 != 0).select(k.alias("res_id"), F.concat(F.lit("S"), k.cast("string")).alias("sync_id"), F.when(k % 10 == 3, F.lit("other")).otherwise(F.lit(UID)).alias("source_dataset"))
    return identity.ownership(links, target).select("res_id", "state")


def _nodes(spark, sf_dir) -> DataFrame:
    """Regions, nations and customers as a tree; one region is missing, so its branch is orphaned."""
    parents = lambda *p: F.array(*p).cast("array<string>")
    region = table(spark, sf_dir, "region").where("r_regionkey <> 3").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), parents().alias("parents"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), parents(F.lit("gone"), F.concat(F.lit("r"), "n_regionkey")).alias("parents"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), parents(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")).alias("parents"))
    return region.unionByName(nation).unionByName(customer)


_PATHS = """np AS (SELECT n_nationkey, n_name, n_regionkey, CASE WHEN r_regionkey IS NULL THEN '/(orphans)/' || n_name ELSE '/' || r_name || '/' || n_name END AS path, r_regionkey IS NULL AS orphan,
    CASE WHEN r_regionkey IS NULL THEN 0 ELSE 1 END AS depth FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 3
), paths AS (
  SELECT 'r' || r_regionkey AS id, '/' || r_name AS path, 0 AS depth, false AS orphan FROM region WHERE r_regionkey <> 3
  UNION ALL SELECT 'n' || n_nationkey, path, depth, orphan FROM np
  UNION ALL SELECT 'c' || c_custkey, path || '/' || c_name, depth + 1, orphan FROM customer JOIN np ON n_nationkey = c_nationkey)"""


@query(f"WITH {_PATHS} SELECT id, path, depth, orphan FROM paths")
def tree_paths(spark, sf_dir):
    return tree.resolve_paths(_nodes(spark, sf_dir)).select("id", "path", "depth", "orphan")


@query("""SELECT 'n' || n_nationkey AS id, 1 AS depth FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'r1', 0""")
def tree_subtree(spark, sf_dir):
    return tree.subtree(_nodes(spark, sf_dir), "r1")


_MIME = """CASE page_id % 6 WHEN 0 THEN 'application/vnd.google-apps.folder' WHEN 1 THEN 'application/vnd.google-apps.spreadsheet' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
  WHEN 3 THEN 'application/vnd.google-apps.form' WHEN 4 THEN 'application/vnd.google-apps.document' ELSE 'image/png' END"""


def _files(spark, sf_dir) -> DataFrame:
    mime = F.expr(_MIME)
    host, path = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    shortcut = F.when(F.col("page_id") % 10 == 9, F.lit("target"))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("id"), host.alias("drive_id"), host.alias("name"), path.alias("path"), mime.alias("mime"), scope.classify(mime, shortcut).alias("node_type"),
        F.array(F.lit("root"), F.substring(path, 1, 3)).alias("ancestors"), F.array(F.when(F.col("page_id") % 4 == 0, F.lit("A@X.org")).otherwise(F.lit("b@x.org"))).alias("owners"),
        (F.col("page_id") % 7 != 0).alias("can_download"), (F.length("html")).cast("bigint").alias("size"),
    )


_FILES = f"""f AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, length(html) AS size, {_MIME} AS mime FROM pages
), t AS (SELECT *, CASE WHEN page_id % 10 = 9 THEN 'shortcut' ELSE CASE page_id % 6 WHEN 0 THEN 'folder' WHEN 1 THEN 'spreadsheet' WHEN 3 THEN 'other' WHEN 4 THEN 'document' ELSE 'blob' END END AS node_type FROM f
), s AS (SELECT *, NOT (page_id % 4 = 0 AND node_type = 'blob') AND NOT ends_with(host, '.com') AND (node_type <> 'document' OR starts_with(path, '/en')) AS in_scope FROM t)"""
RULES = (
    scope.Rule("exclude", "owner", "a@x.org", "blob"),
    scope.Rule("exclude", "name", "*.com"),
    scope.Rule("include", "subtree", "/en", "document"),
)


@query(f"WITH {_FILES} SELECT node_type, count(*) AS n FROM t GROUP BY node_type")
def mime_classify(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FILES} SELECT page_id::VARCHAR AS id, in_scope FROM s")
def scope_filter(spark, sf_dir):
    return _files(spark, sf_dir).select("id", scope.in_scope(RULES).alias("in_scope"))


@query(f"""WITH {_FILES}, d AS (SELECT page_id::VARCHAR AS id, CASE WHEN node_type IN ('folder', 'shortcut') THEN node_type WHEN NOT in_scope THEN 'out_of_scope' WHEN node_type = 'other' THEN 'unsupported_mime'
  WHEN page_id % 7 = 0 THEN 'no_download_permission' WHEN node_type = 'blob' AND size > 3000 THEN 'too_large' END AS skip_reason FROM s)
SELECT id, CASE WHEN skip_reason IS NULL THEN 'ingested' ELSE 'skipped' END AS state, skip_reason FROM d""")
def ingest_dispatch(spark, sf_dir):
    s, r = scope.dispatch(size_limit=3000)
    return _files(spark, sf_dir).withColumn("scoped", scope.in_scope(RULES)).select("id", s.alias("state"), r.alias("skip_reason"))


@query("""WITH k AS (SELECT n_nationkey, n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT - 1 AS i FROM nation)
SELECT n_regionkey::VARCHAR AS file_id, n_nationkey AS tab_id, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE i END AS matched_index,
  CASE n_nationkey % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'normalized_title' WHEN 2 THEN 'index' WHEN 3 THEN 'title' ELSE 'unmatched' END AS matched_by FROM k""")
def tab_rematch(spark, sf_dir):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    k = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("file_id"), F.col("n_nationkey").alias("tab_id"), F.col("n_name").alias("title"), i.alias("tab_index"))
    m = F.col("tab_id") % 5
    live = k.where(m != 4).select("file_id", F.when(m == 1, F.concat(F.lit("  "), F.lower("title"))).when(m == 2, F.lit("renamed")).otherwise(F.col("title")).alias("title"), "tab_index")
    return tabs.rematch(k, live)


@query("""SELECT c_nationkey::VARCHAR AS file_id, c_custkey AS gid, CASE WHEN c_custkey % 97 = 0 THEN 'vanished' WHEN c_custkey % 89 = 0 THEN 'renamed' WHEN c_custkey % 83 = 0 THEN 'new' ELSE 'same' END AS change,
  CASE WHEN c_custkey % 97 <> 0 AND c_custkey % 89 = 0 THEN lower(c_name) ELSE c_name END AS title FROM customer WHERE NOT (c_custkey % 97 = 0 AND c_custkey % 83 = 0 AND c_custkey % 89 <> 0)""")
def tab_sync(spark, sf_dir):
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("file_id"), k.alias("gid"), F.col("c_name").alias("title"))
    known = base.where((F.col("gid") % 83 != 0) | (F.col("gid") % 89 == 0))
    live = base.where(F.col("gid") % 97 != 0).withColumn("title", F.when(F.col("gid") % 89 == 0, F.lower("title")).otherwise(F.col("title")))
    return tabs.sync(known, live)


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def latest_state_replay(spark, sf_dir):
    return replay.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 97 = 0 THEN (CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2026-01-01' ELSE TIMESTAMP '2026-01-15' END)
  WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2026-01-01' END AS missing_since FROM customer""")
def mark_missing(spark, sf_dir):
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    stored = customers.select(k.cast("string").alias("id"), F.when(k % 2 == 0, F.lit("2026-01-01").cast("timestamp_ntz")).alias("missing_since"))
    return state.mark_missing(stored, customers.where(k % 97 != 0).select(k.cast("string").alias("id")), F.lit("2026-01-15").cast("timestamp_ntz"), True)


@query("""SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS first_seen,
  CASE WHEN c_custkey % 5 = 0 THEN 'pending' WHEN c_custkey % 7 = 0 THEN 'skipped' WHEN c_custkey % 97 <> 0 AND c_custkey % 3 = 0 THEN 'pending' ELSE 'ingested' END AS state
FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_custkey % 97 = 0)""")
def upsert_nodes(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    stored = c.where(k % 5 != 0).select(k.cast("string").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("version"), F.lit(1).alias("first_seen"), F.lit(None).cast("int").alias("missing_since"), F.when(k % 7 == 0, F.lit("skipped")).otherwise(F.lit("ingested")).alias("state"))
    live = c.where(k % 97 != 0).select(k.cast("string").alias("id"), F.col("c_name").alias("name"), F.when(k % 3 == 0, 2).otherwise(1).alias("version"))
    return state.upsert_nodes(stored, live, F.lit(2), ["name", "version"], moved=["version"]).select("id", "name", "first_seen", "state")


@query("""WITH r AS (SELECT user_id, event_id, event_type = 'click' AS hit, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events)
SELECT user_id, event_id, CASE WHEN hit THEN sum(hit::INT) OVER (PARTITION BY user_id, island ORDER BY event_id)::BIGINT ELSE 0 END AS streak FROM r""")
def consecutive_runs(spark, sf_dir):
    return reporting.consecutive(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "click")


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type <> 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_row_count FROM events""")
def previous_complete_count(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("row_count"), (F.col("event_type") != "click").alias("read_complete"))
    return reporting.previous_complete(runs, "user_id", "event_id").select("user_id", "event_id", "prev_row_count")


@query("""WITH s AS (SELECT event_id % 40 AS scan, max(ts) AS at FROM events GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL
), last AS (SELECT user_id, max(event_id % 40) AS last FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT u.user_id AS key, count(s.scan) AS missing_run_count, min_by(s.at, s.scan) AS missing_since FROM u LEFT JOIN last USING (user_id) LEFT JOIN s ON s.scan % 3 <> 0 AND (last IS NULL OR s.scan > last) GROUP BY u.user_id""")
def absence_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("scan", F.col("event_id") % 40)
    scans = e.groupBy("scan").agg(F.max("ts").alias("at")).withColumn("complete", F.col("scan") % 3 != 0)
    seen = e.where(F.col("event_type") == "click").select("scan", F.col("user_id").alias("key"))
    return replay.absence(scans, seen, e.where(F.col("user_id").isNotNull()).select(F.col("user_id").alias("key")))


@query("""SELECT count(*) AS datasets, count_if(o_orderstatus = 'F') AS verified, count_if(o_orderstatus = 'O') AS drifting, count_if(o_orderstatus = 'P') AS blocked, sum(o_custkey)::BIGINT AS rows,
  CASE WHEN count_if(o_orderpriority LIKE '1%') > 0 THEN 'critical' ELSE 'info' END AS worst FROM orders""")
def dashboard_rollup(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "F", F.lit("verified")).when(F.col("o_orderstatus") == "O", F.lit("drift")).otherwise(F.lit("blocked"))
    level = F.when(F.startswith("o_orderpriority", F.lit("1")), F.lit("critical")).otherwise(F.lit("info"))
    return reporting.dashboard(table(spark, sf_dir, "orders").select(s.alias("state"), level.alias("severity"), F.col("o_custkey").alias("row_count")))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 5""")
def keep_versions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return state.keep_versions(orders, "o_custkey", "at").select("o_orderkey")


@query("""SELECT id FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 150 = 0 THEN NULL ELSE o_orderdate END AS seen FROM orders) ORDER BY seen NULLS FIRST, id LIMIT 200""")
def due_datasets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 150 != 0, F.col("o_orderdate")).alias("last_verify"))
    return reporting.due(rows).select("id")


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 4 = 0 THEN 'user' WHEN c_custkey % 3 = 0 THEN 'drive_b' ELSE 'drive_a' END AS corpus FROM customer""")
def union_corpora(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), k.alias("k"))
    part = lambda name, cond: c.where(cond).select("id", F.lit(name).alias("corpus"))
    files = part("drive_b", F.col("k") % 3 == 0).unionByName(part("drive_a", F.col("k") % 3 != 0)).unionByName(part("user", F.col("k") % 4 == 0))
    return listings.union_corpora(files, ["user"])


@query("""WITH x AS (SELECT (p_partkey * 7 % 18278)::INT AS i, p_name FROM part)
SELECT i, CASE WHEN i < 26 THEN chr(65 + i) WHEN i < 702 THEN chr(65 + i // 26 - 1) || chr(65 + i % 26) ELSE chr(65 + (i // 26 - 1) // 26 - 1) || chr(65 + (i // 26 - 1) % 26) || chr(65 + i % 26) END AS letters FROM x""")
def column_letters(spark, sf_dir):
    i = (F.col("p_partkey") * 7 % 18278).cast("int")
    return table(spark, sf_dir, "part").select(i.alias("i"), identifiers.column_letters(i).alias("letters"))


_GUARDS = """g AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'no_sync_id' WHEN c_custkey % 3 = 0 THEN 'no_promotion_link' WHEN c_custkey % 5 = 0 THEN 'row_identity_not_sync_id'
  WHEN c_custkey % 7 < 2 THEN 'quarantine_runs' WHEN c_custkey % 11 = 0 THEN 'never_observed_missing' WHEN c_custkey % 13 = 0 THEN 'quarantine_hours' ELSE '' END AS guard FROM customer)"""


@query(f"WITH {_GUARDS} SELECT guard, count(*) AS n FROM g GROUP BY guard")
def delete_guards(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(k % 2 != 0, F.concat(F.lit("S"), k.cast("string"))).alias("sync_id"), k.cast("string").alias("natural_key"), (k % 3 != 0).alias("has_link"),
        F.when(k % 5 == 0, F.lit("natural_key")).alias("identity_source"), (k % 7).cast("int").alias("missing_run_count"),
        F.when(k % 11 != 0, F.when(k % 13 == 0, F.lit("2026-01-14 12:00:00")).otherwise(F.lit("2026-01-01 00:00:00"))).cast("timestamp_ntz").alias("missing_since"),
    )
    guard = planner.delete_guard(planner.Policy(delete_policy="soft"), read_complete=True, blocked=False, now=NOW)
    return rows.groupBy(F.coalesce(guard, F.lit("")).alias("guard")).agg(F.count(F.lit(1)).alias("n"))


def plan_sides(spark, sf_dir) -> tuple[Snapshot, Snapshot]:
    left, right = sides(spark, sf_dir)
    left.rows = left.rows.withColumn("lid", F.col("c_custkey"))
    right.rows = right.rows.withColumn("rid", F.col("c_custkey")).withColumn("source_dataset", F.lit(UID))
    return left, right


@query(f"""WITH {_FIELDS}, a AS (
  SELECT 'create' AS action FROM l ANTI JOIN r USING (k) UNION ALL SELECT 'update' FROM pairs)
SELECT action, count(*) AS n FROM a GROUP BY action""")
def plan_actions(spark, sf_dir):
    left, right = plan_sides(spark, sf_dir)
    p = planner.plan(left, right, planner.Policy(), NOW)
    return p.actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FIELDS}, f AS (
  SELECT 'field_mismatch' AS finding, delta_class FROM diffs UNION ALL SELECT 'missing_in_target', NULL FROM l ANTI JOIN r USING (k) UNION ALL SELECT 'missing_in_source', NULL FROM r ANTI JOIN l USING (k))
SELECT finding, delta_class, count(*) AS n FROM f GROUP BY ALL""")
def plan_findings(spark, sf_dir):
    p = planner.plan(*plan_sides(spark, sf_dir), planner.Policy(), NOW)
    return p.findings.groupBy("finding", "delta_class").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FIELDS}, c AS (SELECT count(*) AS creates FROM l ANTI JOIN r USING (k)), s AS (SELECT count(*) AS source_rows FROM l)
SELECT creates, source_rows, greatest(50.0, 0.2 * source_rows)::DOUBLE AS create_limit, creates > greatest(50.0, 0.2 * source_rows) AS tripped FROM c, s""")
def breakers(spark, sf_dir):
    left, right = plan_sides(spark, sf_dir)
    h = planner.plan(left, right, planner.Policy(), NOW).header
    limit, _ = planner.breaker_limits(planner.Policy(), h["source_rows"], h["target_rows"])
    row = f"SELECT {h['counts'].get('create', 0)}L AS creates, {h['source_rows']}L AS source_rows, {limit}D AS create_limit, {str(h['breaker_tripped']).lower()} AS tripped"
    return spark.sql(row)


@query(f"""WITH {_FIELDS}, b AS (SELECT k, row_number() OVER (ORDER BY CASE a WHEN 'create' THEN 20 ELSE 30 END) - 1 AS position, a FROM (
  SELECT k, 'create' AS a FROM l ANTI JOIN r USING (k) UNION ALL SELECT k, 'update' FROM pairs))
SELECT (position // 200)::INT AS batch_index, count(*) AS n FROM b GROUP BY 1""")
def action_batches(spark, sf_dir):
    p = planner.plan(*plan_sides(spark, sf_dir), planner.Policy(), NOW)
    return planner.with_sequence(p.actions).groupBy("batch_index").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FIELDS} SELECT (SELECT count(*) FROM diffs WHERE delta_class = 'substantive') AS before, 0::BIGINT AS after""")
def apply_convergence(spark, sf_dir):
    """Writable differences before the plan is applied, and after it: none."""
    left, right = plan_sides(spark, sf_dir)
    p = planner.plan(left, right, planner.Policy(), NOW)
    fields = [c.key for c in CUSTOMER]
    text = F.transform_values("canon", lambda k, t: planner.typed_value(t))
    target = right.rows.select("rid", "sync_id", "source_dataset", F.lit(True).alias("active"), text.alias("values"))
    after = store(planner.apply(p.actions, target, fields), "applied")
    flat = spread(after.where("active"), STAGE_ROWS, "sync_id", "rid").select("sync_id", *(F.try_element_at("values", F.lit(f)).alias(f) for f in fields))
    contracts = [Contract(c.key, c.ctype, scale=c.scale, is_key=c.is_key, ascii_only=True) for c in CUSTOMER]
    again = staging.stage(flat, contracts, side="target", extra=False, ascii_only=True).select("key", "canon", "h_row")
    same = staging.stage(spread(table(spark, sf_dir, "customer"), STAGE_ROWS, "c_custkey").select(*(F.col(c.source_column).alias(c.key) for c in CUSTOMER)), contracts, extra=False, ascii_only=True).select("key", "canon", "h_row")
    left_over = compare.field_differences(compare.keyed_comparison(same, again).where("status = 'matched'"), contracts).where("delta_class = 'substantive'").agg(F.count(F.lit(1)).alias("after"))
    deltas = p.actions.where("action = 'update'").select(F.explode("deltas").alias("d")).where(~F.col("d.field").isin("sync_id", "source_dataset"))
    return deltas.agg(F.count(F.lit(1)).alias("before")).crossJoin(left_over)


@query("""WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '15m' WHEN 1 THEN '2h' WHEN 2 THEN '1d' WHEN 3 THEN '45' ELSE 'soon' END AS s FROM events)
SELECT event_id, CASE s WHEN '15m' THEN 900 WHEN '2h' THEN 7200 WHEN '1d' THEN 86400 WHEN '45' THEN 45 END::BIGINT AS seconds FROM x""")
def durations(spark, sf_dir):
    s = F.element_at(F.array(*map(F.lit, ("15m", "2h", "1d", "45", "soon"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", identifiers.duration_seconds(s).alias("seconds"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 500 THEN text[1:500] || '... (+' || (length(text) - 500) || ')' ELSE text END AS clipped FROM documents""")
def clip_values(spark, sf_dir):
    return reporting.clip(table(spark, sf_dir, "documents"), ["text"]).select("doc_id", F.col("text").alias("clipped"))


@query(f"""WITH {_FIELDS}, found AS (
  SELECT k, 'field_mismatch' AS finding, field FROM diffs
  UNION ALL SELECT k, 'missing_in_target', NULL FROM l ANTI JOIN r USING (k) UNION ALL SELECT k, 'missing_in_source', NULL FROM r ANTI JOIN l USING (k)
), hashed AS (
  SELECT sha256(concat_ws(chr(31), k::VARCHAR, finding, coalesce(field, chr(0)))) AS h FROM found
), lines AS (SELECT h, count(*) AS n FROM hashed GROUP BY h
), parts AS (SELECT substr(h, 1, 3) AS g, sha256(string_agg(h || ':' || n || ';', '' ORDER BY h)) AS d FROM lines GROUP BY 1
) SELECT sha256(string_agg(d, '' ORDER BY g)) AS fingerprint FROM parts""")
def findings_fingerprint(spark, sf_dir):
    both = comparison(spark, sf_dir).withColumn("custkey", F.coalesce("l.c_custkey", "r.c_custkey"))
    found = both.where("status <> 'matched'").select("custkey", F.col("status").alias("finding"), F.lit(None).cast("string").alias("field"))
    found = found.unionByName(compare.field_differences(both.where("status = 'matched'"), CUSTOMER, keep=("custkey",)).select("custkey", "finding", "field"))
    return reporting.fingerprint(found, ["custkey", "finding", "field"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN (CASE c_custkey % 3 WHEN 0 THEN 'resolved_externally' WHEN 1 THEN 'applied' ELSE 'resolved_externally' END)
  ELSE CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'applied' ELSE 'planned' END END AS resolution FROM customer""")
def finding_lifecycle(spark, sf_dir):
    k = F.col("c_custkey")
    states = F.element_at(F.array(*map(F.lit, ("open", "applied", "planned"))), (k % 3 + 1).cast("int"))
    c = table(spark, sf_dir, "customer")
    return reporting.lifecycle(c.select("c_custkey", states.alias("resolution")), c.where(k % 97 != 0).select("c_custkey"), ["c_custkey"])


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000) AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def domain_filter(spark, sf_dir):
    domain = ["!", "|", ("o_orderstatus", "=", "F"), ("o_totalprice", "<", 50000), ("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])]
    return table(spark, sf_dir, "orders").where(layered.parse_domain(domain)).select("o_orderkey")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tallyline import ops_queries, source_queries, state_queries  # noqa: F401  register the rest

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
