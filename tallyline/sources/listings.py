"""Listings of files, change feeds and workbooks, from stored JSON responses or data frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = (
    "struct<id string, name string, mimeType string, parents array<string>, modifiedTime string, createdTime string, size string, md5Checksum string, version bigint, trashed boolean,"
    " driveId string, owners array<struct<emailAddress string>>, shortcutDetails struct<targetId string, targetMimeType string>, webViewLink string,"
    " capabilities struct<canDownload boolean>, sharedWithMeTime string>"
)
PAGE_SCHEMA = f"corpus string, page int, pageToken string, nextPageToken string, incompleteSearch boolean, files array<{FILE}>"
CHANGE_SCHEMA = f"changeType string, time string, removed boolean, fileId string, driveId string, file {FILE}"
MAX_CHANGE_PAGES = 200


@dataclass
class Read:
    """Rows and whether the read is complete."""

    rows: DataFrame
    complete: bool
    reasons: tuple[str, ...] = ()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).json(path)


def enumerate_files(pages: DataFrame, predicate: Column | None = None) -> Read:
    """All files of listing pages (corpus, page, tokens, files). A repeated token, a page that follows no other, or a server's
    admission of an incomplete search makes the read incomplete. ``predicate`` is pushed into the scan where it can be."""
    checks = pages.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("pages"), F.count_distinct("nextPageToken").alias("tokens"), F.count_if(F.col("nextPageToken").isNotNull()).alias("following"),
        F.max(F.coalesce("incompleteSearch", F.lit(False))).alias("partial"),
    )
    bad = checks.select(
        F.max(F.col("tokens") != F.col("following")).alias("repeated_token"), F.max(F.col("following") != F.col("pages") - 1).alias("missing_page"), F.max("partial").alias("incomplete_search")
    ).first()
    reasons = tuple(n for n in ("repeated_token", "missing_page", "incomplete_search") if bad[n])
    rows = pages.select("corpus", F.explode("files").alias("f")).select("corpus", "f.*")
    return Read(rows if predicate is None else rows.where(predicate), not reasons, reasons)


def corpus(files: DataFrame, variant: str, *, drive_id: str | None = None, include_trashed: bool = False) -> DataFrame:
    """A variant of the corpus as filters that reach the scan: ``user`` (no shared drive), ``drive`` (one of them), ``shared`` (with the user) or ``all``."""
    own = {"user": F.col("driveId").isNull(), "drive": F.col("driveId") == drive_id, "shared": F.col("sharedWithMeTime").isNotNull(), "all": F.lit(True)}[variant]
    return files.where(own if include_trashed else own & ~F.coalesce("trashed", F.lit(False)))


def union_corpora(files: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """One row for each file id: that of the first corpus in ``ranks`` (others after, by name)."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ranks)), F.col("corpus")), F.lit(0)) if ranks else F.lit(0)
    rank = F.when(rank == 0, F.lit(len(ranks) + 1)).otherwise(rank)
    rest = [c for c in files.columns if c != "id"]
    first = files.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(rank, F.col("corpus"))).alias("r"))
    return first.select("id", "r.*")


def latest_changes(changes: DataFrame, order: str = "time") -> DataFrame:
    """(id, removed, file): the last change of each file; partial aggregation keeps one a task."""
    from tallyline.operators.scope import changed_id, is_removal

    key = changed_id(F.col("fileId"), F.col("file.id"))
    last = changes.where(key.isNotNull()).groupBy(key.alias("id")).agg(F.max_by(F.struct("removed", "file"), F.col(order)).alias("c"))
    return last.select("id", is_removal(F.col("c.removed"), F.col("c.file.trashed")).alias("removed"), F.col("c.file").alias("file"))


def replay(state: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The state (id, columns...) after the latest change of each id (id, removed, file): full outer, idempotent."""
    new = changes.select("id", F.col("removed").alias("__gone"), *(F.col(f"file.{c}").alias(f"__{c}") for c in columns))
    both = state.join(new, "id", "full_outer").where(~F.coalesce("__gone", F.lit(False)))
    return both.select("id", *(F.when(F.col("__gone").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns))


CELL = "struct<numberValue double, stringValue string, boolValue boolean, errorValue struct<type string, message string>, formulaValue string>"
WORKBOOK_SCHEMA = (
    "spreadsheetId string, properties struct<title string, timeZone string, locale string>, sheets array<struct<properties struct<sheetId int, title string, `index` int,"
    f" sheetType string, hidden boolean>, data array<struct<startRow int, startColumn int, rowData array<struct<values array<struct<effectiveValue {CELL}, formattedValue string>>>>>>>>"
)


def tabs_of(workbooks: DataFrame, grid_only: bool = True) -> DataFrame:
    """(file_id, gid, title, tab_index, sheet_type, hidden) of workbook metadata."""
    p = F.col("s.properties")
    rows = workbooks.select(F.col("spreadsheetId").alias("file_id"), F.explode("sheets").alias("s")).select(
        "file_id", p["sheetId"].alias("gid"), p["title"].alias("title"), p["index"].alias("tab_index"), F.coalesce(p["sheetType"], F.lit("GRID")).alias("sheet_type"), F.coalesce(p["hidden"], F.lit(False)).alias("hidden")
    )
    return rows.where(F.col("sheet_type") == "GRID") if grid_only else rows


def typed_cells(workbooks: DataFrame) -> DataFrame:
    """(file_id, gid, row, col, kind, value, formatted) of effective values; missing starts are 0, unknown branches stay as unknown."""
    sheets = workbooks.select(F.col("spreadsheetId").alias("file_id"), F.explode("sheets").alias("s"))
    data = sheets.select("file_id", F.col("s.properties.sheetId").alias("gid"), F.explode("s.data").alias("d"))
    rows = data.select("file_id", "gid", F.coalesce("d.startRow", F.lit(0)).alias("r0"), F.coalesce("d.startColumn", F.lit(0)).alias("c0"), F.posexplode("d.rowData").alias("i", "row"))
    cells = rows.select("file_id", "gid", (F.col("r0") + F.col("i")).alias("row"), "c0", F.posexplode("row.values").alias("j", "cell"))
    e = F.col("cell.effectiveValue")
    kind = (
        F.when(e["errorValue"].isNotNull(), F.lit("error")).when(e["numberValue"].isNotNull(), F.lit("number")).when(e["boolValue"].isNotNull(), F.lit("bool"))
        .when(e["stringValue"].isNotNull(), F.lit("string")).when(e["formulaValue"].isNotNull(), F.lit("formula")).when(e.isNull(), F.lit("empty")).otherwise(F.lit("unknown"))
    )
    value = F.coalesce(e["errorValue"]["type"], e["numberValue"].cast("string"), e["boolValue"].cast("string"), e["stringValue"], e["formulaValue"])
    return cells.select("file_id", "gid", "row", (F.col("c0") + F.col("j")).alias("col"), kind.alias("kind"), value.alias("value"), F.col("cell.formattedValue").alias("formatted"))


#: As ``WORKBOOK_SCHEMA``, with effective values as they came.
VARIANT_SCHEMA = WORKBOOK_SCHEMA.replace(CELL, "variant")
#: The branches of an effective value that are known, with their kinds (fixed values).
BRANCHES = {"errorValue": "error", "numberValue": "number", "boolValue": "bool", "stringValue": "string", "formulaValue": "formula"}


def variant_cells(responses: DataFrame, json: str) -> DataFrame:
    """``typed_cells`` of workbooks as JSON texts. An effective value of no known branch is ``unknown`` and keeps its JSON; numbers keep their digits."""
    books = responses.select(F.from_json(F.col(json), VARIANT_SCHEMA).alias("w")).select("w.spreadsheetId", F.explode("w.sheets").alias("s"))
    data = books.select(F.col("spreadsheetId").alias("file_id"), F.col("s.properties.sheetId").alias("gid"), F.explode("s.data").alias("d"))
    rows = data.select("file_id", "gid", F.coalesce("d.startRow", F.lit(0)).alias("r0"), F.coalesce("d.startColumn", F.lit(0)).alias("c0"), F.posexplode("d.rowData").alias("i", "row"))
    cells = rows.select("file_id", "gid", (F.col("r0") + F.col("i")).alias("row"), "c0", F.posexplode("row.values").alias("j", "cell"))
    e = F.col("cell.effectiveValue")
    branch = {name: F.try_variant_get(e, f"$.{name}" + (".type" if name == "errorValue" else ""), "string") for name in BRANCHES}
    kind = F.when(e.isNull() | F.is_variant_null(e), F.lit("empty"))
    for name, what in BRANCHES.items():
        kind = kind.when(branch[name].isNotNull(), F.lit(what))
    value = F.coalesce(*branch.values(), F.when(e.isNotNull() & ~F.is_variant_null(e), F.to_json(e)))
    return cells.select("file_id", "gid", "row", (F.col("c0") + F.col("j")).alias("col"), kind.otherwise(F.lit("unknown")).alias("kind"), value.alias("value"), F.col("cell.formattedValue").alias("formatted"))


def range_rows(ranges: DataFrame, requested: Sequence[str]) -> Read:
    """(range, row_number, cells) of a batch read (range, values array<array<string>>); a range without an answer makes it incomplete."""
    got = {r["range"] for r in ranges.select("range").distinct().limit(len(requested) + 1).collect()}
    missing = tuple(r for r in requested if r not in got)
    return Read(ranges.select("range", F.posexplode("values").alias("row_number", "cells")), not missing, missing)


def range_batches(titles: Sequence[str], size: int = 100) -> list[list[str]]:
    """Quoted ranges, at most ``size`` a request."""
    quoted = ["'" + t.replace("'", "''") + "'" for t in titles]
    return [quoted[i : i + size] for i in range(0, len(quoted), size)]
