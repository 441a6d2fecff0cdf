"""Registered queries of listings, state, guards, headers, plans and streams' helpers, with their DuckDB SQL."""

from __future__ import annotations

import dataclasses
import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from tallyline.functions import canon, identifiers, numbers
from tallyline.functions.canon import canon as token_of
from tallyline.operators import headers, merkle, reporting, scan, staging, worklist
from tallyline.plans import layered, planner
from tallyline.plans.contract import Contract, spec_version
from tallyline.queries import _FIELDS, CUSTOMER, NOW, UID, plan_sides, sides
from tallyline.registry import query, table
from tallyline.sources import listings, state, xlsx
from tallyline.sources.scratch import folder, store
from tallyline.streaming import replay


def _new_path(spark, tag: str) -> str:
    return f"{folder(spark)}/tallyline/{tag}-{uuid.uuid4().hex}"


def _listing(spark, sf_dir):
    """Pages of listings of four corpora, 40 files each; a page of one corpus is lost, another corpus admits an incomplete search."""
    k = F.col("page_id")
    file = F.to_json(F.struct(
        k.cast("string").alias("id"), F.col("url").alias("name"), F.when(k % 4 == 1, F.lit("d1")).when(k % 4 == 2, F.lit("d2")).alias("driveId"), (k % 9 == 0).alias("trashed"),
        F.when(k % 6 == 0, F.lit("2026-01-01")).alias("sharedWithMeTime"),
    ))
    one = table(spark, sf_dir, "pages").select(F.concat(F.lit("c"), (k % 4).cast("string")).alias("corpus"), F.floor(k / 160).cast("int").alias("page"), F.from_json(file, listings.FILE).alias("f"))
    pages = one.groupBy("corpus", "page").agg(F.collect_list("f").alias("files"))
    last = pages.groupBy("corpus").agg(F.max("page").alias("last"))
    return pages.join(last, "corpus").select(
        "corpus", "page", F.when(F.col("page") > 0, F.concat("corpus", "page")).alias("pageToken"), F.when(F.col("page") < F.col("last"), F.concat("corpus", (F.col("page") + 1).cast("string"))).alias("nextPageToken"),
        ((F.col("corpus") == "c2") & (F.col("page") == 0)).alias("incompleteSearch"), "files",
    )


@query("""SELECT corpus, count(*) AS files, false AS complete, 'incomplete_search' AS reasons FROM (SELECT 'c' || page_id % 4 AS corpus FROM pages) GROUP BY corpus""")
def listed_files(spark, sf_dir):
    """All files of paged listings, of which one search wasn't complete."""
    read = listings.enumerate_files(_listing(spark, sf_dir))
    return read.rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("files")).select("corpus", "files", F.lit(read.complete).alias("complete"), F.lit(",".join(read.reasons)).alias("reasons"))


@query("""SELECT variant, with_trashed, count(*) AS n FROM (SELECT *, unnest([true, false]) AS with_trashed FROM (SELECT page_id, unnest(['user', 'drive', 'shared', 'all']) AS variant FROM pages))
WHERE (with_trashed OR page_id % 9 <> 0) AND CASE variant WHEN 'user' THEN page_id % 4 NOT IN (1, 2) WHEN 'drive' THEN page_id % 4 = 2 WHEN 'shared' THEN page_id % 6 = 0 ELSE true END GROUP BY ALL""")
def corpus_variants(spark, sf_dir):
    files = store(listings.enumerate_files(_listing(spark, sf_dir)).rows.select("id", "driveId", "trashed", "sharedWithMeTime"), "files")
    out = None
    for variant in ("user", "drive", "shared", "all"):
        for trashed in (True, False):
            n = listings.corpus(files, variant, drive_id="d2", include_trashed=trashed).groupBy().agg(F.lit(variant).alias("variant"), F.lit(trashed).alias("with_trashed"), F.count(F.lit(1)).alias("n"))
            out = n if out is None else out.unionByName(n)
    return out.where("n > 0")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'legacy_or_encrypted' WHEN 1 THEN 'not_a_workbook' END AS reason FROM pages""")
def unsupported_workbooks(spark, sf_dir):
    k = F.col("page_id")
    head = F.when(k % 3 == 0, F.unhex(F.lit("D0CF11E0A1B11AE1"))).when(k % 3 == 2, F.unhex(F.lit("504B0304"))).otherwise(F.lit(b""))
    return table(spark, sf_dir, "pages").select("page_id", xlsx.unsupported(F.concat(head, F.coalesce("html", F.lit("")).cast("binary"))).alias("reason"))


@query("""SELECT event_id % 7 AS dataset_id, count(*) AS n, sum(CASE WHEN event_id % 7 IN (2, 5) THEN -event_id ELSE event_id END)::BIGINT AS total FROM events WHERE event_id % 7 NOT IN (2, 5) OR event_id % 2 = 0 GROUP BY 1""")
def replaced_partitions(spark, sf_dir):
    """Two of seven partitions are replaced by other rows; the rest stays as it was written."""
    path, e = _new_path(spark, "partitions"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select((e % 7).alias("dataset_id"), e.alias("v"))
    state.replace_partitions(rows, path)
    state.replace_partitions(rows.where(F.col("dataset_id").isin(2, 5) & (F.col("v") % 2 == 0)).withColumn("v", -F.col("v")), path)
    return spark.read.parquet(path).groupBy(F.col("dataset_id").cast("bigint").alias("dataset_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("""WITH l AS (SELECT coalesce(user_id, -1) AS run, event_id AS seq, CASE WHEN event_id % 401 = 0 THEN 'fatal' WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'error' ELSE 'info' END AS level,
  CASE WHEN user_id % 5 = 0 AND event_id % 4 = 0 THEN 'page ' || event_id END AS incomplete FROM events
), r AS (SELECT run, count(*) AS lines, count_if(level = 'error') AS errors, bool_or(level = 'fatal') AS failed, arg_min(incomplete, seq) FILTER (incomplete IS NOT NULL) AS reason FROM l GROUP BY run)
SELECT run, lines, errors, reason IS NULL AS complete, reason, CASE WHEN failed THEN 'failed' WHEN errors > 0 OR reason IS NOT NULL THEN 'partial' ELSE 'done' END AS state FROM r""")
def run_logs(spark, sf_dir):
    """Runs' records from their log lines, written as gzipped JSON lines and read back."""
    e, u = F.col("event_id"), F.col("user_id")
    level = F.when(e % 401 == 0, F.lit("fatal")).when((F.col("event_type") == "error") & (u % 3 == 0), F.lit("error")).otherwise(F.lit("info"))
    lines = table(spark, sf_dir, "events").select(F.coalesce(u, F.lit(-1)).alias("run"), e.alias("seq"), level.alias("level"), F.when((u % 5 == 0) & (e % 4 == 0), F.concat(F.lit("page "), e.cast("string"))).alias("incomplete"))
    path = _new_path(spark, "log")
    state.write_log(state.run_records(lines), path)
    assert all(f.endswith(".json.gz") for f in spark.read.text(path).inputFiles())
    return spark.read.schema("run bigint, lines bigint, errors bigint, complete boolean, reason string, state string").json(path)


@query(f"""WITH {_FIELDS}
SELECT '{{"custkey":' || k || ',"delta_class":"' || delta_class || '","field":"' || field || '"}}' AS json FROM diffs""")
def report_lines(spark, sf_dir):
    """The findings of a verification as JSON, one object each; the page for readers holds the first hundred, escaped."""
    from tallyline.queries import field_mismatch

    found = field_mismatch(spark, sf_dir)
    page = state.report_html("<Differences>", {"fields": found.count()}, [r.asDict() for r in found.orderBy("custkey", "field").limit(100).collect()])
    assert page.startswith("<!doctype html>") and "<Differences>" not in page
    return state.report_json(found)


@query("""SELECT event_id, coalesce(event_type, 'none') AS event_type, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def retained_rows(spark, sf_dir):
    """A column that old rows lack gets its default, once; rows older than a day before the last go."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    latest = e.agg(F.max("ts")).first()[0]
    old = state.add_column(e.where("event_id % 2 = 0"), "origin", F.lit("old"))
    new = state.add_column(e.where("event_id % 2 = 1").withColumn("origin", F.lit("new")), "origin", F.lit("old"))
    rows = state.retain(old.unionByName(new), "ts", F.lit(latest), 1)
    return rows.select("event_id", F.coalesce("event_type", F.lit("none")).alias("event_type"), "origin")


@query("""WITH c AS (SELECT c_nationkey AS d, 'H' || c_custkey % 40 AS h FROM customer WHERE c_custkey % 4 <> 1 GROUP BY ALL), l AS (SELECT c_nationkey AS d, 'h' || c_custkey % 40 AS h FROM customer WHERE c_custkey % 3 <> 1 OR c_nationkey % 2 = 0 GROUP BY ALL
), b AS (SELECT coalesce(c.d, l.d) AS d, c.h AS declared, l.h AS live FROM c FULL JOIN l ON c.d = l.d AND lower(c.h) = l.h)
SELECT d::VARCHAR AS dataset_id, coalesce(string_agg(declared, '|' ORDER BY declared) FILTER (live IS NULL), '') AS missing, coalesce(string_agg(live, '|' ORDER BY live) FILTER (declared IS NULL), '') AS extra, count_if(live IS NULL) > 0 AS blocked FROM b GROUP BY d""")
def header_gates(spark, sf_dir):
    """Live headers against declared ones, dataset by dataset: what is missing blocks, what is more is growth."""
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    name = lambda p: F.concat(F.lit(p), (k % 40).cast("string")).alias("header")
    dataset = F.col("c_nationkey").cast("string").alias("dataset_id")
    declared = c.where(k % 4 != 1).select(dataset, name("H")).distinct().select("*", F.col("header").alias("key"), F.lit("text").alias("ctype"))
    live = c.where((k % 3 != 1) | (F.col("c_nationkey") % 2 == 0)).select(dataset, name("h")).distinct()
    gates = headers.gates(worklist.bind_headers(live, declared, ascii_only=True))
    return gates.select("dataset_id", F.array_join("missing", "|").alias("missing"), F.array_join("extra", "|").alias("extra"), "blocked")


@query("""WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END AS n, event_id % 7 <> 0 AS complete FROM events WHERE user_id IS NOT NULL
), p AS (SELECT *, last_value(CASE WHEN complete THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r)
SELECT event_id, CASE WHEN NOT complete THEN 'read_incomplete' WHEN n = 0 AND coalesce(prev, 0) > 0 THEN 'empty_tab' END AS finding FROM p""")
def read_guards(spark, sf_dir):
    """Reads that prove nothing: incomplete ones, and empty ones where rows were at the last complete read."""
    e = F.col("event_id")
    runs = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", F.when(e % 5 == 0, 0).otherwise(e).alias("row_count"), (e % 7 != 0).alias("read_complete"))
    runs = reporting.previous_complete(runs, "user_id", "event_id")
    return runs.select("event_id", reporting.empty_guard(F.col("row_count"), F.col("prev_row_count"), F.col("read_complete")).alias("finding"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'e:CELL_ERROR' WHEN 1 THEN 's:' || p_name WHEN 2 THEN 's:#REF' WHEN 3 THEN 'z:' ELSE 's:007' END AS cell, 'e:IDENTIFIER_NUMERIC' AS number_as_code, 's:' || p_size AS on_target,
  p_partkey % 5 IN (1, 2, 4) AS equals_itself FROM part""")
def cell_guards(spark, sf_dir):
    """Error cells and identifiers that a sheet turned into numbers; tokens that are errors or nothing."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.lit(" #REF! ")).when(k % 5 == 1, F.col("p_name")).when(k % 5 == 2, F.lit("#REF")).when(k % 5 == 3, F.lit("  ")).otherwise(F.lit("007"))
    c = Contract("code", "text", identifier=True, ascii_only=True)
    out = table(spark, sf_dir, "part").select("p_partkey", token_of(text, c).alias("cell"), token_of(F.col("p_size"), c, dtype="int").alias("number_as_code"), token_of(F.col("p_size"), c, "target", "int").alias("on_target"))
    return out.withColumn("equals_itself", canon.equal(F.col("cell"), F.col("cell")) & (canon.tag(F.col("cell")) == "s:"))


@query("""SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AS unchanged FROM customer""")
def fast_paths(spark, sf_dir):
    """Datasets that neither side moved since a sound result: one wrong fact of seven is enough to compare anew."""
    k = F.col("c_custkey")
    stored = F.struct(
        F.when(k % 2 == 0, k).alias("version"), F.lit("m").alias("modified"), F.when(k % 3 == 0, F.lit("old")).otherwise(F.lit("spec")).alias("spec_version"), (k % 5 != 0).alias("read_complete"),
        (k % 7 == 0).alias("blocked"), F.when(k % 11 == 0, k - 1).otherwise(k).alias("count"), F.when(k % 13 != 0, F.lit("t")).alias("latest"),
    )
    live = F.struct(k.alias("version"), F.lit("m").alias("modified"), k.alias("count"), F.lit("t").alias("latest"))
    return table(spark, sf_dir, "customer").select("c_custkey", stored.alias("s"), live.alias("l")).select("c_custkey", layered.fast_path("s", "l", "spec").alias("unchanged"))


@query(f"""WITH {_FIELDS}, changed AS (SELECT k FROM diffs UNION SELECT k FROM l ANTI JOIN r USING (k) UNION SELECT k FROM r ANTI JOIN l USING (k)
), b AS (SELECT k, ('0x' || substr(sha256(encode('gos1/bkt') || '\\x00'::BLOB || unhex(lpad(hex(length('n:' || k)), 8, '0')) || encode('n:' || k)), 3, 2))::INT AS bucket FROM (SELECT k FROM l UNION SELECT k FROM r)
), d AS (SELECT DISTINCT bucket FROM b WHERE k IN (FROM changed))
SELECT l.k AS custkey, bucket FROM l JOIN b USING (k) WHERE bucket IN (FROM d)""")
def differing_rows(spark, sf_dir):
    """The source's rows in buckets whose digests differ: all that a comparison has to read."""
    left, right = sides(spark, sf_dir)
    left.rows = store(left.rows, "side")
    differing = merkle.diff_buckets(layered.bucket_table(left), layered.bucket_table(right))
    return merkle.rows_in_buckets(left.rows, differing).select(F.col("c_custkey").alias("custkey"), "bucket")


_EXTRA_SPEC = spec_version((Contract("custkey", "number", column="c_custkey", scale=0, is_key=True),))


@query(f"""SELECT c_custkey AS custkey, substr(sha256(encode('gos1/extra') || '\\x00'::BLOB || encode('{_EXTRA_SPEC}') || '\\x00'::BLOB || encode('{{"balance":"s:' || c_custkey % 9 || '","c_name":"s:' || c_name || '"}}')), 1, 32) AS h_extra FROM customer""")
def extra_hashes(spark, sf_dir):
    """Columns that no contract declares have a hash of their own."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 9).cast("string").alias("Balance"))
    staged = staging.stage(rows, (Contract("custkey", "number", column="c_custkey", scale=0, is_key=True),), keep=["c_custkey"], ascii_only=True)
    return staged.select(F.col("c_custkey").alias("custkey"), "h_extra")


@query("""WITH h AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS header, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders
), s AS (SELECT *, coalesce('_' || lower(replace(header, '-', '_')), '_') AS slug, row_number() OVER (PARTITION BY o_custkey, header ORDER BY pos) AS nth FROM h)
SELECT o_custkey, o_orderkey, CASE WHEN header IS NULL AND nth > 1 THEN '__' || nth WHEN nth > 1 THEN replace(slug, ' ', '_') || '_' || nth ELSE replace(slug, ' ', '_') END AS slug,
  CASE WHEN header IS NULL THEN 's:column#' || pos WHEN nth > 1 THEN 's:' || header || '#' || nth ELSE 's:' || header END AS name FROM s""")
def header_names(spark, sf_dir):
    """Slugs and collision-free names of each customer's headers, some blank, many repeated."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", k, F.when(k % 6 != 0, F.col("o_orderpriority")).alias("header"))
    lists = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "header"))).alias("h"))
    lists = lists.withColumn("names", F.transform("h", lambda x: x["header"]))
    both = lists.select("o_custkey", F.arrays_zip(F.transform("h", lambda x: x["o_orderkey"]).alias("o_orderkey"), headers.slugs("names").alias("slug"), headers.occurrences("names").alias("name")).alias("z"))
    return both.select("o_custkey", F.inline("z"))


@query("""SELECT p_partkey, 'n:' || p_retailprice::DECIMAL(18,0) AS whole, 'n:' || p_retailprice::DECIMAL(18,4) AS fine, 'n:' || (p_size / 8.0)::DECIMAL(18,2) AS eighths, 'n:' || (p_size % 2) || '.0' AS flag, (p_size % 8) IN (4) AS doubtful FROM part""")
def number_scales(spark, sf_dir):
    """Doubles, decimals and booleans in several scales; values that lie on a half step."""
    size = F.col("p_size")
    n = lambda scale: Contract("x", "number", scale=scale)
    eighths = (size / F.lit(8)).cast("decimal(20,3)")
    return table(spark, sf_dir, "part").select(
        "p_partkey", token_of(F.col("p_retailprice"), n(0), dtype="double").alias("whole"), token_of(F.col("p_retailprice"), n(4), dtype="double").alias("fine"), token_of(eighths, n(2), dtype="decimal(20,3)").alias("eighths"),
        token_of(size % 2 == 1, n(1), dtype="boolean").alias("flag"), numbers.near_boundary((size / F.lit(8)).cast("decimal(38,18)"), 0).alias("doubtful"),
    )


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'n:' || event_id WHEN 1 THEN 's:x' WHEN 2 THEN 'e:BAD_DATE' END AS t FROM events)
SELECT event_id, t[1:2] AS tag, t[3:] AS payload, CASE WHEN t LIKE 'e:%' THEN t[3:] END AS code, t NOT LIKE 'e:%' AS same FROM t""")
def token_parts(spark, sf_dir):
    e = F.col("event_id")
    t = F.when(e % 4 == 0, F.concat(F.lit("n:"), e.cast("string"))).when(e % 4 == 1, F.lit("s:x")).when(e % 4 == 2, F.lit("e:BAD_DATE"))
    out = table(spark, sf_dir, "events").select("event_id", t.alias("t"))
    c = F.col("t")
    return out.select("event_id", canon.tag(c).alias("tag"), canon.payload(c).alias("payload"), canon.error_code(c).alias("code"), canon.equal(c, c).alias("same"))


@query("""SELECT count(*) AS n, count(DISTINCT c_custkey) AS ids, count(*) AS valid, count(DISTINCT c_nationkey) AS gids, -(max(c_nationkey) + 1)::BIGINT AS least FROM customer""")
def minted_ids(spark, sf_dir):
    """Identifiers derived from keys: all valid, all different, the same again; surrogate ids of tabs below zero."""
    ids = lambda: identifiers.derived_ulid(1_700_000_000_000, F.lit(UID), F.col("c_custkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(ids().alias("id"), ids().alias("again"), identifiers.surrogate_gid(F.col("c_nationkey")).alias("gid"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(identifiers.is_ulid(F.col("id")) & (F.col("id") == F.col("again"))).alias("valid"), F.count_distinct("gid").alias("gids"),
        F.min("gid").cast("bigint").alias("least"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 OR props IS NULL THEN 0 ELSE 1 END AS entries, CASE WHEN event_id % 10 <> 0 THEN regexp_extract(props, '"k": ([0-9]+)', 1) END AS k FROM events""")
def json_maps(spark, sf_dir):
    """Settings as JSON, of which a tenth is broken."""
    m = identifiers.json_map(F.when(F.col("event_id") % 10 == 0, F.lit('{"k": ')).otherwise(F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", F.size("m").alias("entries"), F.try_element_at("m", F.lit("k")).alias("k"))


@query("""WITH d AS (SELECT c_custkey AS dataset, c_custkey % 3 <> 0 AS complete, c_custkey % 7 = 0 AS blocked, c_custkey % 5 AS s, c_custkey % 2 AS t FROM customer)
SELECT dataset, (row_number() OVER (PARTITION BY dataset ORDER BY i) - 1)::INT AS position, finding FROM (
  SELECT dataset, 0 AS i, 'read_incomplete' AS finding FROM d WHERE NOT complete UNION ALL SELECT dataset, 1, 'empty_tab' FROM d WHERE s = 0 AND t > 0 UNION ALL SELECT dataset, 2, 'header_change' FROM d WHERE blocked)""")
def structural_findings(spark, sf_dir):
    k = F.col("c_custkey")
    datasets = table(spark, sf_dir, "customer").select(k.alias("dataset"), (k % 3 != 0).alias("read_complete"), (k % 7 == 0).alias("blocked"), (k % 5).alias("source_rows"), (k % 2).alias("target_rows"))
    return planner.structural_findings(datasets)


def _flapping_plan(spark, sf_dir, **policy):
    """The customers' plan; the balances of every second record were written back three times before, segments are the target's."""
    left, right = plan_sides(spark, sf_dir)
    columns = tuple(dataclasses.replace(c, authority="target") if c.key == "segment" else c for c in CUSTOMER)
    left.columns = right.columns = columns
    right.rows = right.rows.withColumn("flap_counters", F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("balance"), F.lit(3))))
    return left, right, planner.plan(left, right, planner.Policy(dry_run=False, **policy), NOW)


@query(f"""WITH {_FIELDS}, s AS (SELECT * FROM diffs WHERE delta_class = 'substantive')
SELECT 'non_convergent' AS what, count(*) AS n FROM s WHERE k % 2 = 0 UNION ALL SELECT 'balance', count(*) FROM s WHERE k % 2 = 1 UNION ALL SELECT 'segment', 0""")
def writable_fields(spark, sf_dir):
    """Only differences of the source's own fields are written, and none that came back as often as the limit."""
    _, _, p = _flapping_plan(spark, sf_dir)
    written = p.actions.where("action = 'update'").select(F.explode("deltas").alias("d")).select(F.col("d.field").alias("what"))
    stopped = p.findings.where("finding = 'non_convergent'").select(F.col("finding").alias("what"))
    names = spark.createDataFrame([("non_convergent",), ("balance",), ("segment",)], "what string")
    counts = written.unionByName(stopped).groupBy("what").agg(F.count(F.lit(1)).alias("c"))
    return names.join(counts, "what", "left").select("what", F.coalesce("c", F.lit(0)).cast("bigint").alias("n"))


@query(f"""WITH {_FIELDS}, c AS (SELECT count(*) AS creates FROM l ANTI JOIN r USING (k)), s AS (SELECT count(*) AS source_rows FROM l), b AS (SELECT creates > greatest(50.0, 0.2 * source_rows) AS tripped FROM c, s)
SELECT 'approved' AS situation, '' AS refusal FROM b UNION ALL SELECT 'unapproved', CASE WHEN tripped THEN 'breaker' ELSE 'not_approved' END FROM b
UNION ALL SELECT 'late', 'expired' FROM b UNION ALL SELECT 'moved', 'stale' FROM b UNION ALL SELECT 'dry', 'dry_run' FROM b UNION ALL SELECT 'incomplete', 'blocked' FROM b""")
def refusals(spark, sf_dir):
    """Why a plan may not be applied: a dry run, too late, a target that moved since, a blocked comparison, no approval."""
    left, right, p = _flapping_plan(spark, sf_dir)
    now = planner.fingerprints(left, right)
    moved = now | {"target_rows": right.rows.where("c_custkey <> 1").count()}
    assert planner.is_stale(p.header, moved) == ["target_rows"] and not planner.is_stale(p.header, now)
    blocked = dataclasses.replace(p, header=p.header | {"blocked": True})
    dry = dataclasses.replace(p, header=p.header | {"dry_run": True})
    ask = lambda plan, **o: planner.refusal(plan, **({"now": NOW, "approved": True, "now_prints": now} | o))
    rows = [
        ("approved", ask(p)), ("unapproved", ask(p, approved=False)), ("late", ask(p, now=NOW + timedelta(days=2))), ("moved", ask(p, now_prints=moved)), ("dry", ask(dry)), ("incomplete", ask(blocked)),
    ]
    return spark.createDataFrame(rows, "situation string, refusal string")


@query(f"""WITH {_FIELDS}, u AS (SELECT k, balance FROM r JOIN l USING (k, balance) WHERE false)
SELECT 'update' AS action, k::VARCHAR AS record, 'balance: n:' || rb || ' -> n:' || lb AS change FROM pairs WHERE lb <> rb AND k % 2 = 1""")
def plan_lines(spark, sf_dir):
    """What a plan would change, in words: balances that the source has otherwise."""
    _, _, p = _flapping_plan(spark, sf_dir)
    lines = planner.describe(p.actions.where("action = 'update'").join(p.actions.where("action = 'update'").select("key", "rid"), ["key", "rid"], "left_semi").select("action", "key", "lid", "rid", "sync_id", F.filter("deltas", lambda d: d["field"] == "balance").alias("deltas")))
    lines = lines.where(F.contains("line", F.lit("balance")))
    return lines.select("action", F.regexp_extract("line", "^Update record ([0-9]+): ", 1).alias("record"), F.regexp_extract("line", "^Update record [0-9]+: (.*)$", 1).alias("change"))


@query("""WITH n AS (SELECT count_if(event_type = 'error') AS e, count_if(event_type = 'error' OR event_id = 1) AS f FROM events)
SELECT 0 AS epoch, e AS findings FROM n UNION ALL SELECT 2, 0 FROM n UNION ALL SELECT 3, e FROM n""")
def alerts(spark, sf_dir):
    """Findings of four passes: the second equals the first and is not sent, none at all is a change too."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").cast("string").alias("finding"))
    sent: list = []
    epoch = [0]
    alert = replay.AlertOnChange(["finding"], lambda digest, n: sent.append((epoch[0], n)))
    for i, found in enumerate((errors, errors.repartition(3), errors.limit(0), errors)):
        epoch[0] = i
        alert(found, i)
    return spark.createDataFrame(sent, "epoch int, findings bigint")


@query("""WITH u AS (SELECT user_id, max(ts) AS last, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id), now AS (SELECT max(ts) AS now FROM events), a AS (
  SELECT user_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE epoch_us(now) // 1000000 - epoch_us(last) // 1000000 END AS age, CASE WHEN user_id % 4 = 0 THEN '' WHEN user_id % 9 = 0 THEN NULL ELSE 'c' END AS cursor, user_id % 7 <> 0 AS valid FROM u, now)
SELECT user_id, CASE WHEN age IS NULL THEN 'never' WHEN age > 1500 THEN 'stale' ELSE 'fresh' END AS health, coalesce(cursor, '') = '' OR NOT valid OR age IS NULL OR age > 3000 AS full_scan FROM a""")
def feed_health(spark, sf_dir):
    """Subjects by the age of their last event: which are stale, and which need a full scan before their cursor may be used."""
    u, events = F.col("user_id"), table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    last = events.where(u.isNotNull()).groupBy("user_id").agg(F.max("ts").alias("last")).withColumn("last", F.when(u % 10 != 0, F.col("last")))
    at = F.lit(now).cast("timestamp_ntz")
    seconds = F.unix_timestamp(at) - F.unix_timestamp("last")
    cursor = F.when(u % 4 == 0, F.lit("")).when(u % 9 == 0, F.lit(None)).otherwise(F.lit("c"))
    return last.select("user_id", reporting.health(F.col("last"), at, 600).alias("health"), replay.full_scan_due(cursor, u % 7 != 0, seconds, 3000).alias("full_scan"))


@query("""WITH r AS (SELECT user_id, event_id, event_type = 'error' OR event_id % 3 = 0 AS bad FROM events WHERE user_id IS NOT NULL), i AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM r
), s AS (SELECT event_id, CASE WHEN bad THEN sum(bad::INT) OVER (PARTITION BY user_id, g ORDER BY event_id) ELSE 0 END AS n FROM i)
SELECT event_id, CASE WHEN n = 0 THEN 60 ELSE least(60, 5 * 2 ** (n - 1)) END::DOUBLE AS wait FROM s""")
def poll_waits(spark, sf_dir):
    """The wait after each poll: doubling with failures in a row, never over the interval."""
    runs = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", "event_type")
    failed = scan.streaks(runs, ["user_id"], ["event_id"], (F.col("event_type") == "error") | (F.col("event_id") % 3 == 0), "failures")
    return failed.select("event_id", replay.wait_seconds(F.col("failures"), 60.0).alias("wait"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 < 2 THEN 'ignored' ELSE ['open', 'planned', 'applied'][1 + c_custkey % 3] END AS resolution FROM customer""")
def marked_findings(spark, sf_dir):
    """Chosen findings are ignored, but for those that are applied already."""
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    found = c.select("c_custkey", F.element_at(F.array(*map(F.lit, ("open", "planned", "applied"))), (k % 3 + 1).cast("int")).alias("resolution"))
    return reporting.mark(found, c.where(k % 2 == 0), ["c_custkey"], "ignored")


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 8 AS m FROM customer)
SELECT k AS custkey, m NOT IN (1, 3, 5, 6) AS valid, CASE m WHEN 1 THEN 'k' || k || ': a word is both true and false' WHEN 3 THEN 'k' || k || ': the scale must be resolved and within 0 to 12'
  WHEN 5 THEN '''2k' || k || ''' is no identifier' WHEN 6 THEN 'JSONDecodeError' END AS reason, CASE WHEN m NOT IN (1, 3, 5, 6) THEN 1 ELSE 0 END::BIGINT AS specs FROM c""")
def contract_checks(spark, sf_dir):
    """A declaration for each customer: overlapping words, unresolved scales, bad keys and broken JSON are refused, the others have one version each."""
    k = F.col("c_custkey")
    key, m = F.concat(F.lit("k"), k.cast("string")), k % 8
    quoted = lambda c: F.concat(F.lit('{"key":"'), c, F.lit('",'))
    declared = (
        F.when(m == 1, F.concat(quoted(key), F.lit('"ctype":"bool","truthy":["yes","Ja"],"falsy":["JA"]}'))).when(m == 2, F.concat(quoted(key), F.lit('"ctype":"bool","truthy":["ja"],"falsy":["nein"]}')))
        .when(m == 3, F.concat(quoted(key), F.lit('"ctype":"money","scale":null}'))).when(m == 4, F.concat(quoted(key), F.lit('"ctype":"date","date_formats":["%d.%m.%Y"],"unheard":1}')))
        .when(m == 5, F.concat(quoted(F.concat(F.lit("2"), key)), F.lit('"ctype":"text"}'))).when(m == 6, quoted(key)).otherwise(F.concat(quoted(key), F.lit('"ctype":"number","scale":3}')))
    )
    keys = worklist.spread(table(spark, sf_dir, "customer").select("c_custkey"))
    rows = keys.select(k.alias("custkey"), worklist.checked(declared).alias("c"), worklist.checked(declared).alias("again"))
    same = F.when(F.col("c.spec") == F.col("again.spec"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return rows.select("custkey", "c.valid", "c.reason", same.alias("specs"))
