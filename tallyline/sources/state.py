"""State tables and sinks: upserts, absence marks, partition replacement, retention, logs, reports."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_nodes(stored: DataFrame, live: DataFrame, now: Column, columns: Sequence[str], moved: Sequence[str] = ("version", "modified", "md5")) -> DataFrame:
    """The node table after a listing: first_seen stays, missing_since clears, and content that moved is queued again.

    ``stored`` has id, columns, first_seen, missing_since, state; ``live`` has id and columns. A skipped node stays skipped.
    """
    new = live.select("id", F.lit(True).alias("__live"), *(F.col(c).alias(f"__{c}") for c in columns))
    both = stored.join(new, "id", "full_outer")
    here = F.coalesce("__live", F.lit(False))
    changed = F.lit(False)
    for c in moved:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    state = (
        F.when(~here, F.col("state")).when(F.col("state").isNull(), F.lit("pending")).when(F.col("state") == "skipped", F.lit("skipped"))
        .when(changed | F.col("state").isin("error", "gone"), F.lit("pending")).otherwise(F.col("state"))
    )
    return both.select(
        "id", *(F.when(here, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns), F.coalesce("first_seen", now).alias("first_seen"),
        F.when(~here, F.col("missing_since")).alias("missing_since"), state.alias("state"),
    )


def mark_missing(stored: DataFrame, seen: DataFrame, now: Column, read_complete: bool) -> DataFrame:
    """Set missing_since where an id wasn't seen and the mark isn't set, after complete reads only."""
    if not read_complete:
        return stored
    ids = seen.select("id").distinct().withColumn("__seen", F.lit(True))
    both = stored.join(ids, "id", "left")
    return both.withColumn("missing_since", F.when(F.col("__seen").isNull(), F.coalesce("missing_since", now)).otherwise(F.col("missing_since"))).drop("__seen")


def upsert_datasets(stored: DataFrame, read: DataFrame) -> DataFrame:
    """(file_id, tab_id, row_count, prev_row_count, read_complete): the previous count advances only from complete reads."""
    old = stored.select("file_id", "tab_id", F.col("row_count").alias("o_n"), F.col("prev_row_count").alias("o_p"), F.col("read_complete").alias("o_c"), F.lit(True).alias("o"))
    new = read.select("file_id", "tab_id", F.col("row_count").alias("n_n"), F.col("read_complete").alias("n_c"), F.lit(True).alias("n"))
    both = old.join(new, ["file_id", "tab_id"], "full_outer")
    came = F.col("n").isNotNull()
    prev = F.when(~came, F.col("o_p")).when(F.col("o_c"), F.col("o_n")).otherwise(F.col("o_p"))
    return both.select("file_id", "tab_id", F.when(came, F.col("n_n")).otherwise(F.col("o_n")).alias("row_count"), prev.alias("prev_row_count"), F.when(came, F.col("n_c")).otherwise(F.col("o_c")).alias("read_complete"))


def replace_partitions(rows: DataFrame, path: str, partition: str = "dataset_id") -> None:
    """Replace the partitions that ``rows`` has, and no other; each is dealt to tasks by the partition column and a salt."""
    rows.repartition(partition, F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def retain(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(at) >= now - F.expr(f"INTERVAL '{days}' DAY"))


def keep_versions(df: DataFrame, key: str, order: str, n: int = 5, protect: Column | None = None) -> DataFrame:
    """The latest ``n`` versions of each key (a retention rule), and protected ones. (key, order) is unique.

    The bound on the rank is pushed below the shuffle, so of a key with very many versions ``n`` a task move.
    """
    from pyspark.sql import Window

    top = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__n") <= n).drop("__n")
    if protect is None:
        return top
    return top.unionByName(df.where(protect).join(top.select(key, order), [key, order], "left_anti").select(df.columns))


def add_column(df: DataFrame, name: str, default: Column) -> DataFrame:
    """Additive migration: a column with a seeded default, once."""
    return df if name in df.columns else df.withColumn(name, default)


def write_log(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys, gzipped."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("compression", "gzip").json(path)


def run_state(failed: bool, complete: bool, errors: int) -> str:
    return "failed" if failed else "partial" if errors or not complete else "done"


def run_records(lines: DataFrame) -> DataFrame:
    """(run, lines, errors, complete, reason, state) of the log lines (run, seq, level, incomplete) of many runs.

    ``incomplete`` is why a read was incomplete at a line, else null: the first reason counts. A run with a ``fatal`` line failed,
    one with errors or an incomplete read is partial.
    """
    out = lines.groupBy("run").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("level") == "error").alias("errors"), F.max(F.col("level") == "fatal").alias("failed"),
        F.min(F.when(F.col("incomplete").isNotNull(), F.struct("seq", "incomplete")))["incomplete"].alias("reason"),
    )
    state = F.when(F.col("failed"), F.lit("failed")).when((F.col("errors") > 0) | F.col("reason").isNotNull(), F.lit("partial")).otherwise(F.lit("done"))
    return out.select("run", "lines", "errors", F.col("reason").isNull().alias("complete"), "reason", state.alias("state"))


class Run:
    """A run's log: counters, stages and the first reason for an incomplete read."""

    def __init__(self, kind: str):
        self.kind, self.counters, self.lines, self.complete, self.reason, self.failed = kind, {}, [], True, "", False

    def bump(self, name: str, n: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + n

    def log(self, level: str, message: str) -> None:
        from tallyline.functions.identifiers import redact

        self.lines.append((level, redact(message)))
        if level == "error":
            self.bump("errors")

    def incomplete(self, reason: str) -> None:
        self.complete, self.reason = False, self.reason or reason

    @property
    def state(self) -> str:
        return run_state(self.failed, self.complete, self.counters.get("errors", 0))


def report_json(found: DataFrame) -> DataFrame:
    """One JSON text for each finding."""
    return found.select(F.to_json(F.struct(*sorted(found.columns))).alias("json"))


def report_html(title: str, summary_row: dict, rows: Sequence[dict]) -> str:
    """A small page of a summary and a bounded list of findings; everything is escaped."""
    e = lambda v: html.escape("" if v is None else str(v))
    head = "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in summary_row.items())
    names = list(rows[0]) if rows else []
    body = "".join("<tr>" + "".join(f"<td>{e(r[n])}</td>" for n in names) + "</tr>" for r in rows)
    return f"<!doctype html><title>{e(title)}</title><h1>{e(title)}</h1><table>{head}</table><table><tr>{''.join(f'<th>{e(n)}</th>' for n in names)}</tr>{body}</table>"


def stored_nodes(nodes: DataFrame, mime: str | None = None, include_missing: bool = False) -> DataFrame:
    """Nodes of a media type, by default those that aren't missing."""
    if mime is not None:
        nodes = nodes.where(F.col("mime") == mime)
    return nodes if include_missing else nodes.where(F.col("missing_since").isNull())


def last_run(runs: DataFrame, by: Sequence[str] = ("kind",)) -> DataFrame:
    """The newest run (largest id) of each kind."""
    rest = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*rest), "id").alias("r")).select(*by, "r.*")
