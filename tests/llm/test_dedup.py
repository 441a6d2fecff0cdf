"""WARC records, exact and near deduplication against brute force."""

import base64
import hashlib
import io
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline.llm import exact_dedup, near_dedup, warc
from tallyline.llm.common import scratch_path


def test_warc_round_trip(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "x" * 5000, "x" * 5000, "a\r\n\r\nb", "y" * 64, "<p>é</p>"]
    rows = [(i, None if i == 2 else f"http://h/{i}\r\n", h, "extra") for i, h in enumerate(html)] + [(8, "http://again", "<p>é</p>", "e"), (None, "http://n", "", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    pages = pages.selectExpr("*", "1 AS record_id", "'x' AS bytes", "2 AS chunk_no", "3 AS archive", "'y' AS payload", "'z' AS n")
    path = scratch_path(spark, "test-warc")
    warc.write_warc(pages, path, chunk_bytes=64, archives=2)
    got = sorted(map(tuple, warc.read_warc(spark, path).collect()), key=str)
    groups = defaultdict(list)
    for i, _, h, _ in rows:
        groups[h or ""].append(i)
    want = []
    for i, _, h, _ in rows:
        data, best = (h or "").encode(), max((x for x in groups[h or ""] if x is not None), default=None)
        revisit = best is not None and i != best
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    assert got == sorted(want, key=str)
    archives = [io.BytesIO() for _ in range(2)]
    assert all(warc.export_warc(spark, path, k, f) == len(f.getvalue()) for k, f in enumerate(archives))
    assert sum(f.getvalue().count(b"WARC/1.1\r\n") for f in archives) == len(rows)
    empty = scratch_path(spark, "test-warc")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_running_digests(spark):
    """Each chunk says what the payload's SHA-1 is up to its end; a reader stops at the first chunk that disagrees."""
    payload = "".join(chr(97 + i % 26) for i in range(1000))
    path = scratch_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([(1, "http://h/", payload), (2, None, None)], "page_id long, url string, html string"), path, chunk_bytes=64)
    rows = spark.read.parquet(path).where("n_chunks > 1").orderBy("chunk_no").collect()
    assert len(rows) == 16 and all(r["running"] == hashlib.sha1(payload[: 64 * (i + 1)].encode()).digest() for i, r in enumerate(rows))
    names = [c.split()[0] for c in warc.TABLE_SCHEMA.split(", ")]
    wanted = ["record_id", "chunk_no", "n_chunks", "bytes", "crc32", "running"]
    batch = lambda rows: pa.RecordBatch.from_pylist([{n: r[n] for n in wanted} for r in rows])
    assert names[-1] == "running" and len(list(warc._parse(iter([batch(rows)])))) == 1
    bad = [r.asDict() for r in rows]
    bad[3]["running"] = bad[4]["running"]
    with pytest.raises(ValueError, match="running"):
        list(warc._parse(iter([batch(bad)])))


def test_warc_damage(spark):
    p = warc.RecordParser()
    p.feed(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")
    with pytest.raises(ValueError):
        p.finish()


def test_exact_dedup(spark):
    long = "abc " * 500_000
    texts = ["a b", "a  b", "a\tb", "a\n\nb ", " a b", None, "", " ", "  ", long, long + "x", long, "é", "é", "a b", *(["copy of a long text " * 300] * 60)]
    rows = [(i if i != 14 else 0, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").coalesce(2)
    path = scratch_path(spark, "test-docs")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    got = exact_dedup.dedup(docs)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    want = sorted((i, min(x for x in groups[norm(t)] if x is not None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in rows if i is not None)
    found = got.collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found if r["doc_id"] is not None) == want
    assert sum(r["kept"] for r in found) == len(groups) and all(r["keep_id"] == 0 for r in found if r["doc_id"] is None)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def test_small_blocks_need_many_levels(spark):
    random.seed(2)
    texts = ["".join(random.choice("ab") for _ in range(random.randint(0, 200))) for _ in range(150)]
    texts += texts[:40]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    names = {r["rid"]: tuple(r["identity"]) for r in exact_dedup.identities(rows, block_bytes=4).collect()}
    assert len(names) == len(texts)
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert (names[i] == names[j]) == (texts[i] == texts[j])


def test_consistent_sampling_estimates_similarity():
    rng = np.random.default_rng(4)
    a = rng.choice(1 << 31, 400, replace=False).astype(np.uint32)
    b = np.concatenate([a[:320], rng.choice(1 << 31, 80).astype(np.uint32)])
    wa, wb = rng.uniform(1, 5, 400), None
    wb = np.concatenate([wa[:320], rng.uniform(1, 5, 80)])
    x = near_dedup.Sampler(1024)(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, 400]))
    shared = wa[:320].sum()
    assert abs((x[0] == x[1]).mean() - shared / (wa.sum() + wb.sum() - shared)) < 0.06


def near_fixture():
    """Groups of near copies, one large with every member some edits from a common base, passages shared by different texts."""
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    fresh = lambda n: [word() for _ in range(n)]
    texts = [" ".join(fresh(80)) for _ in range(60)]
    for _ in range(20):
        base = fresh(150)
        texts += [" ".join(base), " ".join(base[:-2] + fresh(2)), " ".join(base) + " " + word()]
    base = fresh(200)
    for _ in range(60):
        copy = list(base)
        copy[random.randrange(200)] = word()
        texts.append(" ".join(copy))
    passage = fresh(60)
    texts += [" ".join(fresh(30) + passage + fresh(10)) for _ in range(40)]
    long = fresh(60_000)
    texts += [" ".join(long), " ".join(long[:-3])]
    texts += [texts[0]] * 30 + [texts[0].upper(), None, "", "one two", "one  TWO", "one three"]
    return texts


def test_near_duplicates(spark):
    texts = near_fixture()
    path = scratch_path(spark, "test-docs")
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string").coalesce(3).write.parquet(path)
    docs = spark.read.parquet(path)
    got = near_dedup.near_duplicates(docs).collect()
    sh, n = near_dedup.Shingler(), len(texts)
    made = [sh(t or "") for t in texts]
    df = defaultdict(int)
    for _, _, s in made:
        for k in set(s.tolist()):
            df[k] += 1
    weights = near_dedup.Weights({k: v for k, v in df.items() if v > 1}, n, 1)
    assert near_dedup.frequent_shingles(near_dedup.shingle_table(docs, "doc_id", "text"), 1) == {k: v for k, v in df.items() if v > 1}
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if made[i][:2] == made[j][:2] or (len(made[i][2]) and len(made[j][2]) and weights.similarity(made[i][2], made[j][2]) >= near_dedup.THRESHOLD):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    want = {i: find(i) for i in range(n)}
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    sizes = defaultdict(int)
    for v in want.values():
        sizes[v] += 1
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    assert max(sizes.values()) >= 60
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(sizes)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_frequencies_and_saturation(spark):
    """Exact frequencies above a bound, from counters that every task adds to; weights vary below and above it."""
    rng = np.random.default_rng(6)
    sets = [np.sort(np.concatenate([rng.zipf(1.3, 200) % 5000, rng.integers(0, 1 << 31, 50)])).astype(np.int32) for _ in range(400)]
    rows = [(i, x.tolist()) for i, x in enumerate(sets)] + [(400, [])]
    table = spark.createDataFrame(rows, "rid long, shingles array<int>").repartition(7)
    df = defaultdict(int)
    for x in sets:
        for k in set(x.tolist()):
            df[k] += 1
    for least in (1, 5, 40.5, 1000):
        assert near_dedup.frequent_shingles(table, least) == {k: v for k, v in df.items() if v > least}
    w = near_dedup.Weights({k: v for k, v in df.items() if v > 5}, 401, 5)
    some = [min(df, key=df.get), max(df, key=df.get)]
    assert np.allclose(w(np.array(some, np.int32)), [1 + np.log(401 / 5), 1 + np.log(401 / df[some[1]])])


def test_frequent_passages_weigh_less(spark):
    """Two texts that share a passage of the whole corpus aren't near copies, at equal shares of a rare passage they are."""
    random.seed(8)
    fresh = lambda n: ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    common, rare = fresh(300), fresh(300)
    texts = [" ".join(common + fresh(25)) for _ in range(60)] + [" ".join(rare + fresh(25)) for _ in range(2)] + [" ".join(fresh(300)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = {r["doc_id"]: r["class_size"] for r in near_dedup.near_duplicates(docs).collect()}
    assert [size[i] for i in (60, 61)] == [2, 2] and {size[i] for i in range(60)} == {1}


def test_repeated_and_null_ids(spark):
    path = scratch_path(spark, "test-docs")
    spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id long, text string").coalesce(1).write.parquet(path)
    got = near_dedup.near_duplicates(spark.read.parquet(path)).collect()
    assert sorted((r["class_size"], r["kept"], str(r["class_id"])) for r in got) == [(1, True, "None"), (3, False, "5"), (3, False, "5"), (3, True, "5")]


def test_bridge_between_families_of_a_large_bucket(spark):
    """Two families in one bucket, each linked to its own hub, and a single link between them."""
    parts = defaultdict(list)
    for r in spark.range(2000).select("id", F.pmod(F.xxhash64("id"), F.lit(near_dedup.HUB_PARTS[-1])).alias("p")).collect():
        parts["first" if r["p"] < near_dedup.HUB_PARTS[0] else "last" if r["p"] >= near_dedup.HUB_PARTS[-2] else ""].append(r["id"])
    rng = np.random.default_rng(3)
    edited = lambda s, n: np.concatenate([rng.permutation(s)[n:], rng.integers(0, 1 << 31, n)]).astype(np.int32)
    h = rng.choice(1 << 31, 1000, replace=False).astype(np.int32)
    c = edited(h, 100)
    d = np.concatenate([h[np.isin(h, c)][100:], np.setdiff1d(c, h), rng.integers(0, 1 << 31, 100)]).astype(np.int32)
    e = np.concatenate([h[np.isin(h, d)][100:], np.setdiff1d(d, h), rng.integers(0, 1 << 31, 100)]).astype(np.int32)
    sets = {parts["last"][0]: c, parts["last"][1]: d}
    sets |= {i: edited(e, 3) for i in [parts["first"][0], *parts["last"][2:10]]}
    sets |= {i: edited(h, 3) for i in parts["last"][-10:]}  # the most central text, by its number, is one of these
    rows = [(int(i), sorted(x.tolist())) for i, x in sets.items()]
    path = scratch_path(spark, "test-sets")
    spark.createDataFrame(rows, "rid long, shingles array<int>").write.parquet(path)
    table = spark.read.parquet(path)
    weights = near_dedup.Weights({}, len(rows), 1)
    signed = near_dedup.signature_table(table, weights).withColumn("triples", F.array_repeat(F.lit(1).cast("long"), near_dedup.TRIPLES))
    members = signed.select(F.lit(1).cast("long").alias("bucket"), F.lit(0).alias("band"), "rid")
    links = near_dedup.links(members, signed, table, weights)
    got = {(r["a"], r["b"]) for r in links.collect()}
    sim = lambda a, b: weights.similarity(np.sort(sets[a]), np.sort(sets[b]))
    home, away = parts["last"][-10:], [parts["first"][0], *parts["last"][2:10]]
    bridges = [(a, b) for a in [*home, parts["last"][0]] for b in [*away, parts["last"][1]] if sim(a, b) >= near_dedup.THRESHOLD]
    assert bridges == [(parts["last"][0], parts["last"][1])] and bridges[0] in got
    assert {r["label"] for r in near_dedup.components(links).collect()} == {min(sets)}


def test_rows_are_numbered_once(spark):
    """The scan's splits differ between jobs, as after the loss of an executor."""
    texts = [f"the text number {i // 2} of many texts" for i in range(24)]
    path = scratch_path(spark, "test-docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    kept = exact_dedup.drop_duplicates(docs)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        assert docs.rdd.getNumPartitions() == 1
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 24, 2))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
