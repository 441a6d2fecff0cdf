"""Findings as data: roll-ups, rankings, fingerprints, lifecycle, health, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.identifiers import clipped
from tallyline.operators import scan

_RANK = ("blocking", "critical", "error", "warning", "info")


def severity_rank(severity: Column) -> Column:
    out = None
    for i, s in enumerate(_RANK):
        out = F.when(severity == s, F.lit(i)) if out is None else out.when(severity == s, F.lit(i))
    return out.otherwise(F.lit(len(_RANK)))


def rollup(found: DataFrame) -> DataFrame:
    """(finding, severity, n), most first."""
    return found.groupBy("finding", "severity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "finding", "severity")


def top(found: DataFrame, order: Sequence[str], k: int = 100) -> DataFrame:
    """The ``k`` gravest findings (the report's length, not a sample)."""
    return found.orderBy(severity_rank(F.col("severity")), *order).limit(k)


def clip(found: DataFrame, columns: Sequence[str], limit: int = 500) -> DataFrame:
    return found.withColumns({c: clipped(F.col(c), limit) for c in columns})


def fingerprint(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One hex digest of a multiset of findings, whatever their order.

    Rows are hashed and equal ones counted before the shuffle; the lines ``hash:count;`` of each of 4,096 parts by the
    hash's first digits stream in order through a running SHA-256, and the parts' digests are hashed in order. Of no findings:
    the digest of nothing.
    """
    from tallyline.operators.merkle import sequence_digests

    row = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)), 256)
    rows = found.select(row.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.substring("h", 1, 3))
    parts = sequence_digests(rows, "g", ("h",), F.lit(b""), F.concat("h", F.lit(":"), F.col("n").cast("string"), F.lit(";")).cast("binary"))
    listed = F.array_sort(F.collect_list(F.struct("g", "digest")))  # 4,096 at most
    return parts.agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["digest"]), ""), 256).alias("fingerprint"))


def dashboard(datasets: DataFrame) -> DataFrame:
    """One row of conditional totals over datasets (state, severity, row_count)."""
    worst = F.max(-severity_rank(F.col("severity")))
    return datasets.agg(
        F.count(F.lit(1)).alias("datasets"), F.count_if(F.col("state") == "verified").alias("verified"), F.count_if(F.col("state") == "drift").alias("drifting"),
        F.count_if(F.col("state") == "blocked").alias("blocked"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"), F.element_at(F.array(*map(F.lit, (*_RANK, "none"))), (-worst + 1).cast("int")).alias("worst"),
    )


def health(last_run: Column, now: Column, interval_seconds: int) -> Column:
    """fresh, stale (older than two and a half intervals) or never."""
    age = F.unix_timestamp(now) - F.unix_timestamp(last_run)
    return F.when(last_run.isNull(), F.lit("never")).when(age > 2.5 * interval_seconds, F.lit("stale")).otherwise(F.lit("fresh"))


def lifecycle(stored: DataFrame, current: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stored findings with their next resolution: an open or planned one that is gone was resolved elsewhere; new ones open.

    applied and ignored stay as they are.
    """
    now = current.select(*on).distinct().withColumn("seen", F.lit(True))
    both = stored.join(now, list(on), "full_outer")
    lost = F.col("seen").isNull() & F.col("resolution").isin("open", "planned")
    state = F.when(F.col("resolution").isNull(), F.lit("open")).when(lost, F.lit("resolved_externally")).otherwise(F.col("resolution"))
    return both.withColumn("resolution", state).drop("seen")


def mark(found: DataFrame, chosen: DataFrame, on: Sequence[str], resolution: str) -> DataFrame:
    """Chosen open findings become planned, applied or ignored."""
    hit = chosen.select(*on).distinct().withColumn("hit", F.lit(True))
    allowed = F.col("resolution").isin("open", "planned")
    return found.join(hit, list(on), "left").withColumn("resolution", F.when(F.col("hit") & allowed, F.lit(resolution)).otherwise(F.col("resolution"))).drop("hit")


def due(datasets: DataFrame, limit: int = 200) -> DataFrame:
    """Work to do: never verified first, then the longest ago (``limit`` is the pass's size)."""
    return datasets.orderBy(F.asc_nulls_first("last_verify"), "id").limit(limit)


def consecutive(runs: DataFrame, key: str, order: str, hit: Column, least: int = scan.LEAST) -> DataFrame:
    """(key, order, streak): how many runs in a row, up to this one, the condition held. A frequent key is spread (``operators.scan``)."""
    return scan.streaks(runs, [key], [order], hit, "streak", least).select(key, order, "streak")


def previous_complete(runs: DataFrame, key: str, order: str, least: int = scan.LEAST) -> DataFrame:
    """With ``prev_row_count``: the row count of the last complete read before each run. A frequent key is spread."""
    return scan.last_before(runs, [key], [order], F.when(F.col("read_complete"), F.col("row_count")), "prev_row_count", least)


def empty_guard(row_count: Column, prev_row_count: Column, read_complete: Column) -> Column:
    """The finding of an empty or incomplete read: none, read_incomplete, or empty_tab where rows were before."""
    return F.when(~read_complete, F.lit("read_incomplete")).when((row_count == 0) & (F.coalesce(prev_row_count, F.lit(0)) > 0), F.lit("empty_tab"))


def dataset_report(datasets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Datasets with their file's name and path; those without a file go."""
    return datasets.join(nodes.select("file_id", "name", "path"), "file_id")


def drift_report(found: DataFrame, datasets: DataFrame, nodes: DataFrame, run_id: object | None = None, finding: str | None = None) -> DataFrame:
    """Findings with their dataset's title and file's name, which may both be gone."""
    if run_id is not None:
        found = found.where(F.col("run_id") == run_id)
    if finding is not None:
        found = found.where(F.col("finding") == finding)
    d = datasets.select("dataset_id", "file_id", "title")
    return found.join(d, "dataset_id", "left").join(nodes.select("file_id", "name"), "file_id", "left")


def counters(rows: DataFrame, by: Sequence[str], state: str, states: Sequence[str]) -> DataFrame:
    """(by..., total, one column for each state): grouped counts, one row for each group."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(state) == s).alias(s) for s in states))


def listing(rows: DataFrame, order: Sequence[str], text: Column, k: int = 50) -> DataFrame:
    """(position, line): the first ``k`` lines (the listing's length) and, if there are more, one that says how many."""
    from pyspark.sql import Window

    first = rows.orderBy(*order).limit(k).select(F.row_number().over(Window.orderBy(*order)).alias("position"), text.alias("line"))
    rest = rows.agg((F.count(F.lit(1)) - k).alias("n")).where(F.col("n") > 0)
    return first.unionByName(rest.select(F.lit(k + 1).alias("position"), F.concat(F.lit("+"), F.col("n").cast("string"), F.lit(" more")).alias("line")))
