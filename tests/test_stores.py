"""Stores by bucket, unreadable rows, feeds and timers over restarts, suggestions."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tallyline.functions import text
from tallyline.operators import compare, merkle, staging
from tallyline.operators.staging import Snapshot
from tallyline.plans import layered, suggest
from tallyline.plans.contract import Contract, slugify
from tallyline.sources import cursors, feed, rowstore, xlsx
from tallyline.sources.scratch import store
from tallyline.streaming import replay

COLUMNS = (Contract("code", is_key=True), Contract("amount", "number"))


def side(spark, rows, name="source"):
    staged = staging.stage(spark.createDataFrame(rows, "code string, amount string"), COLUMNS, side=name, extra=False)
    return Snapshot(staged, COLUMNS, "u/0")


def found(v):
    return {(r["finding"], r["field"], r["source_token"], r["target_token"]) for r in v.findings.collect()}


def test_unreadable_rows(spark):
    good, bad = [("1", "1"), ("2", "2"), ("3", "3")], [("1", "1"), ("2", "oops"), ("3", "3")]
    v = layered.verify(side(spark, bad), side(spark, good, "target"))
    assert v.result == "unreadable" and found(v) == {("type_coercion", "amount", "e:NOT_A_NUMBER", None)}
    v = layered.verify(side(spark, good), side(spark, bad, "target"))
    assert v.result == "unreadable" and found(v) == {("type_coercion", "amount", None, "e:NOT_A_NUMBER")}
    v = layered.verify(side(spark, bad), side(spark, bad, "target"))
    assert v.result == "unreadable" and found(v) == {("type_coercion", "amount", "e:NOT_A_NUMBER", "e:NOT_A_NUMBER")}
    v = layered.verify(side(spark, bad + [("4", "4")]), side(spark, good, "target"))
    assert v.result == "drift" and ("missing_in_target", None, None, None) in found(v) and len(found(v)) == 2
    assert layered.verify(side(spark, good), side(spark, good, "target")).result == "verified"


def test_row_store_digests_only_what_changed(spark, tmp_path):
    rows = [(f"k{i}", str(i)) for i in range(3000)]
    s, t = (rowstore.RowStore(spark, str(tmp_path / x)) for x in "st")
    with pytest.raises(ValueError):
        s.apply(side(spark, rows[:1]).rows.withColumn("gone", F.lit(False)))
    assert s.count() == 0 and s.rows().count() == 0 and s.digests().where("n > 0").count() == 0
    s.replace(side(spark, rows).rows)
    t.replace(side(spark, rows, "target").rows)
    spec = side(spark, rows).spec_version
    check = lambda: layered.verify_stored(s, t, COLUMNS, spec, "u/0")
    assert check().mode == "dataset_digest"
    edits = side(spark, [("k5", "-5"), ("k77", "x"), ("new", "1"), ("k9", "9")]).rows.withColumn("gone", F.col("canon.code") == "s:k9")
    touched = s.apply(edits)
    assert len(touched) <= 4 and s.rows_read < 100 and s.count() == 3000
    after = [(c, {"k5": "-5", "k77": "x"}.get(c, a)) for c, a in rows if c != "k9"] + [("new", "1")]
    whole = layered.bucket_table(side(spark, after))
    assert merkle.diff_buckets(whole, s.digests()).count() == 0
    v = check()
    assert v.result == "drift" and v.rows_compared < 200
    assert {f[0] for f in found(v)} == {"field_mismatch", "type_coercion", "missing_in_target", "missing_in_source"}
    assert {r["generation"] for r in s.manifest().select("generation").distinct().collect()} == {1, 2}
    s.apply(edits.limit(0))
    assert check().result == "drift"
    s.replace(edits.limit(0))  # a version without rows is one
    assert s.count() == 0 and s.rows().count() == 0 and s.digests().where("n > 0").count() == 0 and check().mode == "empty_tab"
    s.apply(edits.where(~F.col("gone")))
    assert s.count() == 3


def test_replay_rewrites_touched_buckets(spark, tmp_path):
    schema = "changeType string, time string, removed boolean, fileId string, driveId string, file struct<id string, name string, trashed boolean>"
    batch = lambda ids, n, gone=False: spark.createDataFrame([("file", f"t{n}", gone, i, None, None if gone else {"id": i, "name": f"v{n}", "trashed": False}) for i in ids], schema)
    sink = replay.ReplaySink(str(tmp_path / "s"), ["name"], buckets=64)
    assert sink.read(spark) is None
    sink(batch([f"f{i}" for i in range(2000)], 0), 0)
    assert sink.rows_written == 2000
    sink(batch(["f7"], 1), 1)
    assert sink.rows_written < 100 and sink.rows_read == sink.rows_written
    sink(batch(["f7", "f8"], 2, True), 2)
    sink(batch(["f7", "f8"], 2, True), 2)  # a repeated batch
    sink(batch([], 3), 3)
    state = {r["id"]: r["name"] for r in sink.read(spark).collect()}
    assert state == {f"f{i}": "v0" for i in range(2000) if i not in (7, 8)}
    # A manifest names 64 buckets; those of the last two differ in the buckets of one batch.
    assert sink.versions(spark) == [2, 3] and 64 <= len(list((tmp_path / "s" / "rows").glob("generation=*/bucket=*"))) <= 68


def pages(n, changes=3):
    """A feed of n pages: token -> page."""
    made = {}
    for p in range(n):
        rows = [{"changeType": "file", "time": f"{p:03}{c}", "removed": (p + c) % 5 == 0, "fileId": f"f{(p * changes + c) % 11}", "file": {"id": f"f{(p * changes + c) % 11}", "name": f"p{p}c{c}"}} for c in range(changes)]
        made[f"t{p}"] = {"changes": rows, **({"nextPageToken": f"t{p + 1}"} if p < n - 1 else {"newStartPageToken": f"t{n}"})}
    return made


def run_feed(spark, tmp_path, name, made, runs, per_batch):
    source = feed.change_feed(lambda subject, token: made.get(token, {"changes": [], "newStartPageToken": token}), {"a": "t0"}, pages=per_batch, name=name)
    spark.dataSource.register(source)
    sink = replay.ReplaySink(str(tmp_path / f"{name}-state"), ["name"], buckets=8)
    for _ in range(runs):
        replay.start_replay(spark.readStream.format(name).load(), sink, str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    return sorted((r["id"], r["name"]) for r in sink.read(spark).collect()), sink


def test_feed_goes_on_after_a_stop(spark, tmp_path):
    """Stopped after every third page and started anew, the state is that of one uninterrupted run."""
    whole, _ = run_feed(spark, tmp_path, "feed_whole", pages(8), 1, 100)
    parts, sink = run_feed(spark, tmp_path, "feed_parts", pages(8), 4, 3)
    assert whole == parts and whole
    last = sorted((tmp_path / "feed_parts-checkpoint" / "offsets").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    assert json.loads(last.read_text().splitlines()[-1]) == {"a": "t8"}  # the cursor
    again, _ = run_feed(spark, tmp_path, "feed_parts", pages(10), 1, 100)  # the feed grew
    assert again == run_feed(spark, tmp_path, "feed_longer", pages(10), 1, 100)[0] != whole


def test_feed_that_cannot_be_followed():
    reader = lambda made: feed.FeedReader(lambda s, t: made[t], {"a": "t0"}, None, 10)
    loop = {"t0": {"changes": [1], "nextPageToken": "t1"}, "t1": {"changes": [1], "nextPageToken": "t0"}}
    for made in (loop, {"t0": {"changes": [1]}}, {"t0": {"nextPageToken": "t0"}}):
        with pytest.raises(feed.FeedError):
            reader(made).latestOffset()
    quiet = reader({"t0": {"changes": [], "newStartPageToken": "t9"}})
    assert quiet.latestOffset() == {"a": "t0"} and quiet.initialOffset() == {"a": "t0"}
    r = reader(pages(4))
    assert r.latestOffset() == {"a": "t4"} and [p.token for p in r.partitions({"a": "t1"}, {"a": "t4"})] == ["t1", "t2", "t3"]


def test_many_facts_become_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cursors, "COMPACT_FILES", 4)
    memory = cursors.MetaStore(spark, str(tmp_path / "facts"))
    for i in range(7):
        memory.put_all(spark.createDataFrame([("a", str(i)), (f"b{i}", "x")], "name string, value string"))
    memory.put("b3", None)
    assert len(memory._files()) < 7 and memory.get("a") == "6"
    assert {r["name"] for r in cursors.newest(memory.facts()).collect()} == {"a", *(f"b{i}" for i in range(7) if i != 3)}


def test_both_absence_limits(spark, tmp_path):
    """Runs first and hours later, hours first and runs later: each makes a key due once both are reached."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = tmp_path / "in"
    source.mkdir()
    schema = "key string, scan long, seen boolean, complete boolean"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"d{n}"))
    out: list = []

    def keep(batch, epoch):
        out.extend(tuple(r) for r in batch.collect())

    put(0, [("fast", 1, False, True), ("fast", 2, False, True), ("slow", 1, False, True), ("back", 1, False, True), ("part", 1, False, False)])
    stream = replay.absence_timers(spark.readStream.schema(schema).parquet(str(source / "*")), 2, 4000)
    query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        wait = lambda done: [time.sleep(0.2) for _ in iter(lambda: not done() and time.time() < end, False)]
        wait(lambda: len(out) >= 4)
        put(1, [("back", 2, True, True)])
        wait(lambda: any(r[0] == "fast" and r[3] for r in out))  # its timer
        wait(lambda: any(r[0] == "back" and r[1] == 0 for r in out))
        assert not any(r[0] == "slow" and r[3] for r in out)
        put(2, [("slow", 3, False, True)])
        wait(lambda: any(r[0] == "slow" and r[3] for r in out))
    finally:
        query.stop()
    due = {r[0]: r[1] for r in out if r[3]}
    assert due == {"fast": 2, "slow": 2}
    assert ("part", 0, None, False) in out and [r[1] for r in out if r[0] == "back"] == [1, 0]


def test_suggestions(spark):
    headers = spark.createDataFrame([("a", "Invoice Number", None), ("a", "Due Date", None), ("a", "SKU", None), ("a", "Größe", "number"), ("a", "Ö", "mixed"), ("b", "id", None), ("b", "sku", None), ("b", "", None)], "dataset string, header string, kind string")
    got = {(r["dataset"], r["header"]): (r["slug"], r["ctype"], r["identifier"], r["is_key"]) for r in suggest.types(headers, suggest.vocabulary(spark)).collect()}
    assert got["a", "Invoice Number"] == ("invoice_number", "text", True, False) and got["a", "Due Date"][1] == "date"
    assert got["a", "SKU"] == ("sku", "text", True, True) and not got["b", "sku"][3] and not got["b", "id"][3]
    assert got["a", "Größe"] == (slugify("Größe"), "number", False, False) and got["b", ""][0] == "_"
    slugs = ["Café No. 1", "1st", "***", "s:Tab", "Ünïcode", "a__b", "Straße"]
    assert [r["s"] for r in spark.createDataFrame([(x,) for x in slugs], "h string").select(suggest.slug(F.col("h")).alias("s")).collect()] == list(map(slugify, slugs))
    targets = spark.createDataFrame([("name", "char", "Name"), ("list_price", "float", "Unit Price"), ("price_unit", "float", "Price"), ("email", "char", "E-Mail"), ("qty", None, None)], "field string, ftype string, label string")
    wanted = spark.createDataFrame([("unit_price", "money"), ("name", "text"), ("customer_email", "text"), ("qty", "number"), ("colour", "text"), ("name", "money")], "slug string, ctype string")
    got = {(r["slug"], r["ctype"]): r["field"] for r in suggest.fields(wanted, targets).collect()}
    assert got == {("unit_price", "money"): "list_price", ("name", "text"): "name", ("customer_email", "text"): "email", ("qty", "number"): "qty", ("colour", "text"): None, ("name", "money"): None}


def test_native_folding_and_normal_form(spark):
    import unicodedata

    samples = ["Straße", "ΣΑΣ", "İstanbul", "É", "é", "Ångström", "ﬁne", "가", "각", "ﷺ", "ǅ", "日本", "क़", "Ꭰ", "plain", "", "á̧", "Ω", "ſ", "ŉ", "ꭰ"]
    every = "".join(chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000)
    samples += [every[i : i + 1] for i in range(0, len(every), 3)]
    df = spark.createDataFrame([(s,) for s in samples], "s string").select("s", text.casefold(F.col("s")).alias("f"), text.nfc(F.col("s")).alias("n"))
    for r in df.collect():
        assert r["f"] == r["s"].casefold(), (r["s"], r["f"])
        assert r["n"] == unicodedata.normalize("NFC", r["s"]), r["s"]


def test_workbook_rows_in_batches(spark, monkeypatch):
    monkeypatch.setattr(xlsx, "BATCH_CELLS", 10)
    content = xlsx.write_workbook([("One", [["a", 1]] * 30 + [[]] * 3 + [["", None]]), ("Two", []), ("Three", [[], [], ["x", " "]])])
    files = spark.createDataFrame([("f", bytearray(content)), ("bad", bytearray(b"PK\x03\x04nope")), ("nul", None)], "path string, content binary")
    rows = xlsx.workbook_rows(files)
    got = rows.where("row_number is not null").collect()
    assert sorted((r["tab_index"], r["row_number"]) for r in got) == [*((0, i) for i in range(30)), (2, 2)] and all(r["file_id"] == "f" for r in got)
    tabs = {(r["file_id"], r["tab_index"]): r for r in xlsx.tabs_of(rows).collect()}
    assert tabs["f", 1]["read_complete"] and tabs["f", 2]["gid"] == -3 and not tabs["bad", None]["read_complete"] and tabs["nul", None]["warnings"]


def test_outcomes_fold_no_numbers(spark):
    """Numbers have no cosmetic form: an ASCII contract's comparison runs no Python."""
    a, b = (store(side(spark, rows, n).rows, "side") for rows, n in (([("1", "1"), ("2", "2")], "source"), ([("1", "1"), ("2", "3")], "target")))
    columns = (Contract("code", is_key=True, ascii_only=True), Contract("amount", "number"))
    out = compare.outcomes(a, b, columns)
    assert {r["outcome"]: r["n"] for r in out.collect()} == {"equal": 1, "substantive": 1}
    assert "ArrowEvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()
