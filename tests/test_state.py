"""Digests, comparisons and counts at the edges; cursors, alerts, replay and absence against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyline import taxonomy as tx
from tallyline.operators import compare, merkle, reporting, staging
from tallyline.plans.contract import Contract
from tallyline.sources import cursors
from tallyline.sources.scratch import store
from tallyline.streaming import replay


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_bucket_digests_stream_through_many_batches(spark):
    random.seed(1)
    rows = [(b, bytearray(f"k{random.random()}".encode() * random.randint(1, 20)), hashlib.md5(str(i).encode()).hexdigest()) for i, b in enumerate([7] * 25_000 + [9] * 40 + [255])]
    df = spark.createDataFrame(rows, "bucket int, key binary, h string").repartition(5)
    want = {}
    for b in {r[0] for r in rows}:
        own = sorted((bytes(k), h) for x, k, h in rows if x == b)
        body = b"".join(varint(len(k)) + k + bytes.fromhex(h) for k, h in own)
        want[b] = (len(own), hashlib.sha256(tx.BUCKET_PREFIX + varint(b) + varint(len(own)) + body).hexdigest()[:32])
    assert {r["bucket"]: (r["n"], r["digest"]) for r in merkle.bucket_digests(df).collect()} == want
    assert merkle.bucket_digests(df.limit(0)).count() == 0


def test_fingerprint_is_of_a_multiset(spark):
    rows = [(f"a{i % 50}", None if i % 7 else "x") for i in range(500)]
    of = lambda x: reporting.fingerprint(spark.createDataFrame(x, "a string, b string"), ["a", "b"]).first()[0]
    one = of(rows)
    assert one == of(random.Random(3).sample(rows, len(rows))) and one != of(rows[1:]) and one != of([*rows, rows[0]])
    assert of([]) == hashlib.sha256(b"").hexdigest()


def test_unequal_comparison_sees_what_the_whole_one_finds(spark):
    columns = (Contract("id", "number", scale=0, is_key=True), Contract("v", "number", scale=1))
    left = [(str(i), str(i)) for i in range(60)] + [("5", "5"), (None, "1"), ("x", "2")]
    right = [(str(i), "bad" if i % 11 == 0 else str(i + (i % 7 == 0))) for i in range(3, 70)] + [("9", "9")]
    staged = [store(staging.stage(spark.createDataFrame(r, "id string, v string"), columns, side=s, extra=False, ascii_only=True).select("key", "canon", "h_row"), "t") for r, s in ((left, "source"), (right, "target"))]
    whole, part = compare.keyed_comparison(*staged), compare.unequal_comparison(*staged)
    found = lambda c: sorted(map(str, compare.findings(c, columns).collect()))
    assert found(whole) == found(part) and len(found(part)) > 20
    assert part.count() < whole.count()


def test_counts_reach_rows_of_frequent_and_missing_keys(spark):
    keys = ["hot"] * 3000 + [f"k{i // 2}" for i in range(400)] + [f"s{i}" for i in range(50)] + [None] * 700
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    n = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND key IS NOT NULL"), "t")
    got = staging.join_counts(rows, n, "key", "n").collect()
    want = Counter(k for k in keys if k is not None)
    assert len(got) == len(keys)
    assert all(r["n"] == (want[r["key"]] if r["key"] and want[r["key"]] > 1 else None) for r in got)


def test_absence(spark):
    rng = random.Random(5)
    scans = [(s, f"t{s:02}", rng.random() < 0.7) for s in range(30)]
    seen = [(rng.randrange(30), f"k{rng.randrange(40)}") for _ in range(60)]
    keys = [f"k{i}" for i in range(50)]
    got = replay.absence(spark.createDataFrame(scans, "scan int, at string, complete boolean"), spark.createDataFrame(seen, "scan int, key string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    last = defaultdict(lambda: -1)
    for s, k in seen:
        last[k] = max(last[k], s)
    for r in got.collect():
        missed = [at for s, at, c in scans if c and s > last[r["key"]]]
        assert (r["missing_run_count"], r["missing_since"]) == (len(missed), missed[0] if missed else None)
    assert got.count() == 50


def test_cursors_and_alerts_outlive_a_restart(spark, tmp_path):
    s = cursors.MetaStore(spark, str(tmp_path / "facts"))
    assert s.get("x") is None
    s.put("x", "1")
    s.put("x", "2")
    s.put("y", "3")
    assert (s.get("x"), s.get("y")) == ("2", "3")
    s.put("x", None)
    assert s.get("x") is None
    page = lambda subject, p, token, following, start, ids: (subject, p, token, following, start, [{"changeType": "file", "time": f"t{i}", "removed": False, "fileId": i, "driveId": None, "file": None} for i in ids])
    pages = spark.createDataFrame(
        [page("a", 0, "s", "1", "early", ["f1", "f2"]), page("a", 1, "1", None, "next", []), page("b", 0, "s", "1", None, ["f3"]), page("c", 0, "s", None, "fresh", [])], cursors.CHANGE_PAGE_SCHEMA
    )
    read, state = cursors.read_feed(pages)
    assert not read.complete and read.reasons == ("unfinished",) and read.rows.count() == 3
    assert cursors.advance(s, state, ["a", "b", "c"]) == {"a": "next", "c": "fresh"}
    assert cursors.cursor(s, "a") == "next" and cursors.cursor(s, "b") is None
    sent = []
    found = spark.createDataFrame([("a",), ("b",)], "finding string")
    for _ in range(2):  # a new object, as after a restart
        replay.AlertOnChange(["finding"], lambda h, n: sent.append(n), memory=s)(found, 0)
    replay.AlertOnChange(["finding"], lambda h, n: sent.append(n), memory=s)(found.limit(1), 1)
    assert sent == [2, 1]


def test_replay_keeps_two_versions(spark, tmp_path):
    sink = replay.ReplaySink(str(tmp_path / "state"), ["name"])
    batch = lambda i: spark.createDataFrame([("file", f"t{i}", False, f"f{i}", None, {"id": f"f{i}", "name": f"n{i}", "trashed": False})], "changeType string, time string, removed boolean, fileId string, driveId string, file struct<id string, name string, trashed boolean>")
    for i in range(4):
        sink(batch(i), i)
    sink(batch(3), 3)  # a repeated batch
    assert sink.versions(spark) == [2, 3]
    assert {r["id"] for r in sink.read(spark).collect()} == {"f0", "f1", "f2", "f3"}
