"""Scans of frequent keys, path doubling, rule tables, samples, against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyline.operators import profile, scan, scope, tree


@pytest.fixture
def many_ranges(spark):
    """As many ranges as shuffle partitions: frequent keys get several segments each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans(spark, many_ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "warm", None, f"k{i % 900}"]), i, rng.random() < 0.97 if i % 2500 < 2000 else True, rng.random() < 0.01) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, i long, hit boolean, full boolean").repartition(5)
    out = scan.streaks(df, ["k"], ["i"], F.col("hit"), "streak", 100)
    out = scan.last_before(out, ["k"], ["i"], F.when(F.col("full"), F.col("i")), "last", 100)
    out = scan.numbered(out, ["k"], ["i"], "nth", 100)
    want, state = {}, defaultdict(lambda: [0, None, 0])
    for k, i, hit, full in rows:
        s = state[k]
        s[0] = s[0] + 1 if hit else 0
        s[2] += 1
        want[i] = (k, s[0], s[1], s[2])
        s[1] = i if full else s[1]
    assert {r["i"]: (r["k"], r["streak"], r["last"], r["nth"]) for r in out.collect()} == want
    plain = scan.numbered(df, ["k"], ["i"], "nth")  # too few rows for any key to be frequent
    assert {r["i"]: r["nth"] for r in plain.collect()} == {i: w[3] for i, w in want.items()}
    assert scan.streaks(df.limit(0), ["k"], ["i"], F.col("hit"), "s", 0).count() == 0


def test_deep_chains_and_cycles(spark):
    nodes = [(f"n{i}", f"N{i}", [f"n{i - 1}"] if i else []) for i in range(1000)]
    nodes += [("a", "A", ["b"]), ("b", "B", ["c"]), ("c", "C", ["a"]), ("d", "D", ["c"]), ("lost", "Lost", ["gone"]), ("below", "Below", ["lost"]), ("self", "Self", ["self", "n0"]), ("nul", "Nul", None)]
    got = {r["id"]: r for r in tree.resolve_paths(spark.createDataFrame(nodes, "id string, name string, parents array<string>")).collect()}
    assert len(got) == len(nodes) and got["n999"]["depth"] == 999 and got["n999"]["ancestors"] == [f"n{i}" for i in range(999)]
    assert got["n999"]["path"] == "/" + "/".join(f"N{i}" for i in range(1000)) and not got["n999"]["orphan"]
    assert all(got[x]["orphan"] and got[x]["depth"] == 0 for x in "abcd")
    assert (got["lost"]["path"], got["below"]["path"], got["below"]["orphan"]) == ("/(orphans)/Lost", "/(orphans)/Lost/Below", True)
    assert (got["self"]["path"], got["nul"]["path"], got["nul"]["orphan"]) == ("/N0/Self", "/Nul", False)
    assert tree.resolve_paths(spark.createDataFrame([], "id string, name string, parents array<string>")).count() == 0


def test_shortcut_targets(spark):
    nodes = spark.createDataFrame([("a", "A", None), ("s", "S", "a"), ("t", "T", "gone")], "id string, name string, target string")
    assert {tuple(r) for r in tree.shortcut_targets(nodes).collect()} == {("s", "a", "A"), ("t", "gone", None)}


def test_rule_table_equals_the_list(spark):
    rng = random.Random(9)
    pick = rng.choice
    nodes = [
        (f"f{i}", pick(["d1", "d2", None]), pick(["A.txt", "b.csv", "x[1]", "Über.md", None]), pick(["/a/b", "/c", ""]), pick(["text/plain", "image/png"]), pick(["blob", "document", "folder"]),
         [pick(["root", "f1", "f2"]) for _ in range(rng.randrange(3))], pick([[], ["A@x.org"], ["b@x.org", "C@x.org"], None]))
        for i in range(200)
    ]
    df = spark.createDataFrame(nodes, "id string, drive_id string, name string, path string, mime string, node_type string, ancestors array<string>, owners array<string>")
    values = {"subtree": ["root", "f1", "f7"], "drive": ["d1"], "owner": ["a@X.org", "c@x.org"], "mime": ["image/*", "text/plain"], "name": ["*.txt", "b.csv", "[!x]*", "x?1]"], "path": ["/a/*", "/c"]}
    for _ in range(6):
        rules = []
        for _ in range(rng.randrange(1, 6)):
            kind = pick(list(values))
            rules.append(scope.Rule(pick(["include", "exclude"]), kind, pick(values[kind]), pick(["", "blob", "document"])))
        frame = spark.createDataFrame([(r.effect, r.kind, r.value, r.applies_to or None) for r in rules], "effect string, kind string, value string, applies_to string")
        got = {r["id"]: r["in_scope"] for r in scope.judge(df, frame).collect()}
        assert got == {r["id"]: r["s"] for r in df.select("id", scope.in_scope(rules).alias("s")).collect()}, rules
    none = spark.createDataFrame([], "effect string, kind string, value string, applies_to string")
    assert scope.judge(df, none).where("in_scope").count() == 200
    with pytest.raises(ValueError):
        scope.judge(df, spark.createDataFrame([("include", "colour", "red", "")], "effect string, kind string, value string, applies_to string"))


def test_samples_scan_once(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("at"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("a"), F.concat(F.lit("v"), F.col("id") % 7).alias("b"), F.lit(" ").alias("c"))
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    got = profile.samples(stored, ["a", "b", "c"], "at")
    assert {r["column"]: r["sample"] for r in got.collect()} == {"a": [str(i) for i in range(15) if i % 3][:10], "b": [f"v{i % 7}" for i in range(10)]}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan
