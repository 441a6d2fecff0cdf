"""Workbooks in the office format, read from binary rows with the standard library alone."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.identifiers import column_index

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
MAX_ROWS, MAX_COLUMNS = 500_000, 2_048
SCHEMA = "file_id string, tab_index int, gid int, title string, hidden boolean, read_complete boolean, warnings array<string>, rows array<array<string>>"


def unsupported(content: Column) -> Column:
    """Why content is no readable workbook: the old binary format, or no zip archive; else null."""
    head = F.substring(content, 1, 8)
    return F.when(head == F.lit(bytearray.fromhex("D0CF11E0A1B11AE1")), F.lit("legacy_or_encrypted")).when(F.substring(content, 1, 4) != F.lit(bytearray(b"PK\x03\x04")), F.lit("not_a_workbook"))


def _tabs(content: bytes) -> Iterator[tuple[int, str, bool, Callable[[], Iterator[tuple[int, list[str]]]], dict]]:
    """(tab_index, title, hidden, rows, state) of each tab; ``rows()`` yields (row number, texts) and leaves in ``state`` whether all was read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, si in ET.iterparse(f):
                    if si.tag == f"{_MAIN}si":
                        shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
                        si.clear()
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ET.fromstring(z.read("xl/workbook.xml")).find(f"{_MAIN}sheets")
        for i, s in enumerate(sheets if sheets is not None else ()):
            target = rels[s.get(f"{_REL}id")].lstrip("/")
            state: dict = {"complete": True, "warnings": set(), "rows": 0}

            def rows(path: str = target if target.startswith("xl/") else f"xl/{target}", state: dict = state) -> Iterator[tuple[int, list[str]]]:
                with z.open(path) as f:
                    yield from _sheet(f, shared, state)

            yield i, s.get("name"), s.get("state", "visible") != "visible", rows, state


def _sheet(f, shared: list[str], state: dict) -> Iterator[tuple[int, list[str]]]:
    """(row number, texts) of the rows that have any, one at a time. Trailing blanks go; a formula without a stored value
    makes the tab incomplete; numbers keep their stored literal."""
    expected = 0
    body = None
    for event, row in ET.iterparse(f, ("start", "end")):
        if event == "start":
            body = row if row.tag == f"{_MAIN}sheetData" else body
            continue
        if row.tag != f"{_MAIN}row":
            continue
        at = int(row.get("r", expected + 1)) - 1
        expected = at + 1
        if at >= MAX_ROWS:
            state["complete"] = False
            state["warnings"].add("too_many_rows")
            return
        cells: dict[int, str] = {}
        for k, c in enumerate(row.iter(f"{_MAIN}c")):
            col = column_index(m[0]) if (m := re.match("[A-Za-z]+", c.get("r", ""))) else k
            if col >= MAX_COLUMNS:
                state["complete"] = False
                state["warnings"].add("too_many_columns")
                break
            v, kind = c.find(f"{_MAIN}v"), c.get("t", "n")
            if kind == "inlineStr":
                cells[col] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif v is None or v.text is None:
                if c.find(f"{_MAIN}f") is not None:
                    state["complete"] = False
                    state["warnings"].add("formula_without_value")
            elif kind == "s":
                cells[col] = shared[int(v.text)]
            elif kind == "b":
                cells[col] = "TRUE" if v.text == "1" else "FALSE"
            else:
                cells[col] = v.text
        while cells and not cells[max(cells)].strip():
            del cells[max(cells)]
        if cells:
            state["rows"] = at + 1
            yield at, [cells.get(i, "") for i in range(max(cells) + 1)]
        if body is not None:
            body.clear()  # rows that were read


ROW_SCHEMA = "file_id string, tab_index int, row_number int, cells array<string>, title string, hidden boolean, read_complete boolean, warnings array<string>"
#: Cells in a batch of rows.
BATCH_CELLS = 65_536


def workbook_rows(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """The rows of all tabs of workbooks, in batches of some ``BATCH_CELLS`` cells, whatever the size of a tab.

    One task reads one file. A row with texts is (file_id, tab_index, row_number from 0, cells); each tab ends with a row without
    ``row_number`` that says whether all of it was read (``tabs_of``). A damaged file gives one such row without a tab, not complete, after the rows read before.
    """
    types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string())]
    names = ["file_id", "tab_index", "row_number", "cells", "title", "hidden", "read_complete", "warnings"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, held, size = batch.column(0)[i].as_py(), [], 0
                try:
                    for tab, title, hidden, rows, state in _tabs(batch.column(1)[i].as_py() or b""):
                        for at, cells in rows():
                            held.append((key, tab, at, cells, None, None, None, None))
                            size += len(cells) + 1
                            if size >= BATCH_CELLS:
                                yield batch_of(held)
                                held, size = [], 0
                        held.append((key, tab, None, None, title, hidden, state["complete"], sorted(state["warnings"])))
                except Exception as e:  # the file is data
                    held.append((key, None, None, None, None, False, False, [type(e).__name__]))
                yield batch_of(held)

    return files.select(F.col(id_col).cast("string"), F.col(content_col)).mapInArrow(run, ROW_SCHEMA)


def tabs_of(rows: DataFrame) -> DataFrame:
    """(file_id, tab_index, gid, title, hidden, read_complete, warnings) of what ``workbook_rows`` gave; ``gid`` is a surrogate below 0."""
    ends = rows.where(F.col("row_number").isNull())
    return ends.select("file_id", "tab_index", (-1 - F.col("tab_index")).alias("gid"), "title", "hidden", "read_complete", "warnings")


def read_workbook(content: bytes) -> list[tuple]:
    """(tab_index, title, hidden, read_complete, warnings, rows of texts) of one small workbook."""
    out = []
    for i, title, hidden, rows, state in _tabs(content):
        found: list[list[str]] = []
        for at, cells in rows():
            found.extend([] for _ in range(at - len(found)))
            found.append(cells)
        out.append((i, title, hidden, state["complete"], sorted(state["warnings"]), found))
    return out


def read_workbooks(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """A row for each tab of each workbook, its rows in one array: for small tabs; ``workbook_rows`` is for all. A damaged file gives one row that is not complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    found = read_workbook(content.as_py() or b"")
                except Exception as e:  # the file is data
                    found = [(None, None, False, False, [type(e).__name__], [])]
                rows = [(key, i, None if i is None else -(1 + i), *rest) for i, *rest in found]
                columns = list(zip(*rows)) if rows else [[]] * 8
                types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))]
                names = ["file_id", "tab_index", "gid", "title", "hidden", "read_complete", "warnings", "rows"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return files.select(F.col(id_col).cast("string"), F.col(content_col)).mapInArrow(run, SCHEMA)


def write_workbook(tabs: list[tuple[str, list[list]]]) -> bytes:
    """A minimal workbook (inline strings, numbers, booleans) from (title, rows)."""
    from xml.sax.saxutils import escape, quoteattr

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        sheets = "".join(f'<sheet name={quoteattr(t)} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (t, _) in enumerate(tabs))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{sheets}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(tabs)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, (_, rows) in enumerate(tabs):
            body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
