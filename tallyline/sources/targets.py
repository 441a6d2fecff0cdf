"""The target side: schema, scans with completeness, link state, point lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators.staging import Snapshot, stage
from tallyline.plans.contract import Contract


@dataclass
class TargetRead:
    """Rows of a target with what one pass over them found."""

    rows: DataFrame
    count: int
    max_write_date: object
    complete: bool


def schema_of(df: DataFrame) -> DataFrame:
    """(field, type, nullable) of a table, from its metadata."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "field string, type string, nullable boolean")


def filled_schema(df: DataFrame) -> DataFrame:
    """(field, type, rows, filled): ``schema_of`` with how many rows have a value, counted in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(df.columns)))
    cells = (F.struct(F.lit(c).alias("field"), F.lit(t).alias("type"), F.col("rows"), F.col(f"n_{i}").alias("filled")) for i, (c, t) in enumerate(df.dtypes))
    return counts.select(F.inline(F.array(*cells)))


def missing_fields(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that the table lacks; never an error."""
    return [n for n in names if n not in df.columns]


def get(df: DataFrame, id_col: str, value: object) -> DataFrame:
    """The row of an id: a filter that reaches the scan."""
    return df.where(F.col(id_col) == F.lit(value))


def scan(df: DataFrame, fields: Sequence[str], *, id_col: str, where: Column | None = None, limit: int | None = None, modified: str | None = None) -> TargetRead:
    """The wanted fields of the rows of a domain. Count and latest change come from one pass before; over ``limit`` rows the read is
    incomplete and holds the first by id, so that it proves no absence."""
    rows = df if where is None else df.where(where)
    latest = F.max(modified) if modified else F.lit(None).cast("timestamp")
    found = rows.agg(F.count(F.lit(1)).alias("n"), latest.alias("latest")).first()
    complete = limit is None or found["n"] <= limit
    out = rows.select(*fields)
    return TargetRead(out if complete else out.orderBy(id_col).limit(limit), found["n"], found["latest"], complete)


def with_links(records: DataFrame, links: DataFrame, on: str = "sync_id") -> DataFrame:
    """Records with ``has_link`` and their link's state, absence mark and count; a record without an identity has none."""
    known = links.select(F.col(on).alias("__sync"), F.col("state").alias("link_state"), "missing_since", "missing_run_count").where(F.col("__sync").isNotNull())
    return records.join(known, F.col(on) == F.col("__sync"), "left").withColumn("has_link", F.col("__sync").isNotNull()).drop("__sync")


def snapshot(read: TargetRead, columns: Sequence[Contract], *, uid: str = "", sync_id: str | None = None, links: DataFrame | None = None, keep: Sequence[str] = ()) -> Snapshot:
    """A target read as a staged side, with link state joined in."""
    rows = stage(read.rows, columns, side="target", sync_id=sync_id, keep=keep)
    if links is not None:
        rows = with_links(rows, links)
    latest = None if read.max_write_date is None else str(read.max_write_date)
    return Snapshot(rows, tuple(columns), uid, read_complete=read.complete, row_count=read.count, max_write_date=latest)
