"""Listings, workbooks, state tables, reports and streams."""

import json

from pyspark.sql import functions as F

from tallyline.operators import reporting, tree
from tallyline.sources import cursors, listings, state, xlsx
from tallyline.streaming import replay


def test_listing_pages(spark):
    schema = "corpus string, page int, pageToken string, nextPageToken string, incompleteSearch boolean, files array<struct<id string, name string>>"
    good = spark.createDataFrame([("u", 0, None, "t1", False, [("a", "A")]), ("u", 1, "t1", None, False, [("b", "B")])], schema)
    read = listings.enumerate_files(good)
    assert read.complete and read.rows.count() == 2
    bad = spark.createDataFrame([("u", 0, None, "t1", False, []), ("u", 1, "t1", "t1", True, [])], schema)
    assert listings.enumerate_files(bad).reasons == ("repeated_token", "missing_page", "incomplete_search")


def test_feeds_with_two_faults(spark):
    """A repeated token outranks a missing page, but only while both pages that carry it are there."""
    feeds = {"whole": (0, 1, 2), "three": (0, 2), "four": (0, 1, 3)}
    rows = [(s, p, f"t{p}", None if p == max(ps) else "t1" if s != "whole" else f"t{p + 1}", f"new-{s}" if p == max(ps) else None, None) for s, ps in feeds.items() for p in ps]
    found = cursors.feed_state(spark.createDataFrame(rows, cursors.CHANGE_PAGE_SCHEMA)).collect()
    assert {r["subject"]: (r["pages"], r["complete"], r["reason"], r["cursor"]) for r in found} == {
        "whole": (3, True, None, "new-whole"), "three": (2, False, "missing_page", None), "four": (3, False, "repeated_token", None)
    }


def test_typed_cells(spark, tmp_path):
    book = {"spreadsheetId": "f", "sheets": [
        {"properties": {"sheetId": 5, "title": "T", "index": 0, "sheetType": "GRID"}, "data": [{"startRow": 2, "rowData": [{"values": [
            {"effectiveValue": {"numberValue": 1.5}, "formattedValue": "1.5"}, {"effectiveValue": {"errorValue": {"type": "REF"}}}, {"effectiveValue": {"boolValue": True}}, {}]}]}]},
        {"properties": {"sheetId": 6, "title": "Chart", "index": 1, "sheetType": "OBJECT", "hidden": True}},
    ]}
    (tmp_path / "b.json").write_text(json.dumps(book))
    books = spark.read.schema(listings.WORKBOOK_SCHEMA).json(str(tmp_path / "b.json"))
    assert [r["gid"] for r in listings.tabs_of(books).collect()] == [5]
    cells = [(r["row"], r["col"], r["kind"], r["value"]) for r in listings.typed_cells(books).orderBy("col").collect()]
    assert cells == [(2, 0, "number", "1.5"), (2, 1, "error", "REF"), (2, 2, "bool", "true"), (2, 3, "empty", None)]


def test_workbooks(spark):
    content = xlsx.write_workbook([("One & only", [["Name", "Amount"], ["a", 1.5], [None, True], ["", None]]), ("Two", [])])
    files = spark.createDataFrame([("f", bytearray(content)), ("bad", bytearray(b"zzz"))], "path string, content binary")
    rows = {(r["file_id"], r["tab_index"]): r for r in xlsx.read_workbooks(files).collect()}
    one = rows["f", 0]
    assert one["title"] == "One & only" and one["gid"] == -1 and one["read_complete"]
    assert one["rows"] == [["Name", "Amount"], ["a", "1.5"], ["", "TRUE"]]
    assert rows["f", 1]["rows"] == [] and not rows["bad", None]["read_complete"]
    assert [r[0] for r in files.select(xlsx.unsupported(F.col("content"))).collect()] == [None, "not_a_workbook"]


def test_replay_stream_and_restart(spark, tmp_path):
    schema = "changeType string, time string, removed boolean, fileId string, driveId string, file struct<id string, name string, trashed boolean>"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def emit(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)

    emit([("file", "1", False, "a", None, ("a", "A", False)), ("file", "1", False, "b", None, ("b", "B", False)), ("file", "2", False, "a", None, ("a", "A2", False))])
    sink = replay.ReplaySink(out, ["name"])
    replay.start_replay(spark.readStream.schema(schema).json(source), sink, checkpoint).awaitTermination(120)
    assert {r["id"]: r["name"] for r in sink.read(spark).collect()} == {"a": "A2", "b": "B"}
    emit([("file", "3", True, "b", None, None), ("file", "3", False, "c", None, ("c", "C", False)), ("file", "4", False, "a", None, ("a", "A", True))])
    replay.start_replay(spark.readStream.schema(schema).json(source), sink, checkpoint).awaitTermination(120)
    assert {r["id"]: r["name"] for r in sink.read(spark).collect()} == {"c": "C"}
    sink(spark.read.schema(schema).json(source), 99)  # a repeated batch changes nothing
    assert {r["id"] for r in sink.read(spark).collect()} == {"c"}


def test_absence_stream(spark, tmp_path):
    schema = "key string, scan long, seen boolean, complete boolean"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, True, True), ("a", 2, False, True), ("a", 3, False, False), ("a", 4, False, True), ("b", 1, True, True)], schema).coalesce(1).write.json(source)
    stream = replay.absence_stream(spark.readStream.schema(schema).json(source))
    stream.writeStream.format("memory").queryName("absent").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r["key"]: (r["missing_run_count"], r["missing_since_scan"]) for r in spark.table("absent").collect()}
    assert got == {"a": (2, 2), "b": (0, None)}


def test_state_tables(spark, tmp_path):
    stored = spark.createDataFrame([("f", 0, 500, None, True)], "file_id string, tab_id int, row_count int, prev_row_count int, read_complete boolean")
    for n, complete, expected in ((400, True, 500), (0, False, 400), (0, True, 400)):
        stored = spark.createDataFrame(state.upsert_datasets(stored, spark.createDataFrame([("f", 0, n, complete)], "file_id string, tab_id int, row_count int, read_complete boolean")).collect(), stored.schema)
        assert stored.first()["prev_row_count"] == expected
    guard = spark.range(1).select(reporting.empty_guard(F.lit(0), F.lit(19845), F.lit(True)).alias("a"), reporting.empty_guard(F.lit(0), F.lit(0), F.lit(True)).alias("b"), reporting.empty_guard(F.lit(0), F.lit(5), F.lit(False)).alias("c")).first()
    assert tuple(guard) == ("empty_tab", None, "read_incomplete")
    path = str(tmp_path / "rows")
    state.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "dataset_id int, v string"), path)
    state.replace_partitions(spark.createDataFrame([(2, "c")], "dataset_id int, v string"), path)
    assert {(r["dataset_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    run = state.Run("crawl")
    run.log("error", "token=abc")
    run.incomplete("first")
    run.incomplete("second")
    assert run.state == "partial" and run.reason == "first" and run.lines == [("error", "token=***")]
    assert "&lt;b&gt;" in state.report_html("<b>", {"n": 1}, [{"x": "<i>"}])


def test_tree_cycles(spark):
    rows = [("r", "root", []), ("a", "A", ["gone", "r"]), ("x", "X", ["y"]), ("y", "Y", ["x"]), ("s", "S", ["s", "a"]), ("o", "O", ["gone"])]
    paths = {r["id"]: (r["path"], r["orphan"]) for r in tree.resolve_paths(spark.createDataFrame(rows, "id string, name string, parents array<string>")).collect()}
    assert paths["s"] == ("/root/A/S", False) and paths["o"] == ("/(orphans)/O", True) and paths["x"][1] and len(paths) == 6


def test_alert_only_on_change(spark):
    sent = []
    alert = replay.AlertOnChange(["x"], lambda f, n: sent.append(n))
    a = spark.createDataFrame([("1",), ("2",)], "x string")
    alert(a, 0)
    alert(a.orderBy(F.desc("x")), 1)
    alert(a.limit(1), 2)
    assert sent == [2, 1]
    assert replay.backoff(3, 60) == 20 and replay.backoff(9, 60) == 60 and replay.needs_full_scan(None, True, 1, 10)
