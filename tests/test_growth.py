"""Steps whose memory, traffic or tasks must not outgrow the input."""

import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyline import ops_queries, queries, source_queries
from tallyline.operators import identity, tree, worklist
from tallyline.plans.contract import jcs
from tallyline.sources import feed, listings


def test_a_page_is_read_in_parts_and_the_driver_sees_tokens_only(spark, tmp_path):
    n = 2 * feed.BATCH_ROWS + 5
    at = F.col("id")
    changes = spark.range(n).select(F.lit("s0").alias("subject"), F.when(at == 0, F.lit(0)).otherwise(F.lit(2)).cast("bigint").alias("page"), F.concat(F.lit("f"), at.cast("string")).alias("fileId"), F.lit("ü \n").alias("time"))
    source_queries.write_feed(changes, str(tmp_path), 4)  # pages 1 and 3 are empty
    uri = f"file://{tmp_path}"
    asked = []
    pages = feed.stored_pages(f"{uri}/pages")
    schema = spark.createDataFrame([], f"subject string, {listings.CHANGE_SCHEMA}").schema
    reader = feed.FeedReader(lambda s, t: asked.append(t) or pages(s, t), {"s0": "t0"}, schema, 10, feed.stored_tokens(f"{uri}/tokens"))
    assert reader.latestOffset() == {"s0": "t3"}  # the last page has nothing new
    parts = reader.partitions({"s0": "t0"}, {"s0": "t3"})
    assert [p.token for p in parts] == ["t0", "t1", "t2"] and not asked
    batches = [[b.num_rows for b in reader.read(p)] for p in parts]
    assert batches == [[1], [], [feed.BATCH_ROWS, feed.BATCH_ROWS, 4]] and asked == ["t0", "t1", "t2"]
    assert {r["time"] for b in reader.read(parts[0]) for r in b.to_pylist()} == {"ü \n"}


def test_roots_equal_the_paths_and_stay_narrow(spark, monkeypatch):
    nodes = [(f"n{i}", None if i % 3 == 0 else f"N{i}", [f"n{i - 1}"] if i % 50 else []) for i in range(200)]
    nodes += [("a", "A", ["b"]), ("b", "B", ["a"]), ("c", "C", ["a"]), ("lost", "Lost", ["gone"]), ("below", "", ["lost"]), ("self", "Self", ["self", "n0"]), ("nul", None, None)]
    df = spark.createDataFrame(nodes, "id string, name string, parents array<string>")
    paths = {r["id"]: r for r in tree.resolve_paths(df).collect()}
    assert (paths["n0"]["path"], paths["n4"]["path"], paths["below"]["path"], paths["nul"]["path"]) == ("/", "/N1/N2/N4", "/(orphans)/Lost/", "/")
    cut, kinds = tree._cut, set()
    monkeypatch.setattr(tree, "_cut", lambda d: kinds.update(t for _, t in d.dtypes) or cut(d))
    got = {r["id"]: (r["root"], r["above"], r["depth"], r["orphan"]) for r in tree.resolve_roots(df).collect()}
    ends = lambda a: (a[0], a[-1]) if a else (None, None)
    assert got == {i: (*ends(r["ancestors"]), r["depth"], r["orphan"]) for i, r in paths.items()}
    assert kinds == {"string", "int", "boolean"}  # no chain is written


def test_declarations_are_checked_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(worklist, "CHECK_ROWS", 150)
    got = ops_queries.contract_checks(spark, str(tmp_path))
    sizes = [r["n"] for r in got.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 7 and sum(sizes) == 1000 and max(sizes) <= 150
    text = "".join(map(chr, range(1, 128))) + "ü\u2028"
    assert json.loads(jcs({"a": text, "b": "plain"})) == {"a": text, "b": "plain"}


def plain_cascade(left, right, strategy):
    out, l, r = [], dict((x[0], x[1:]) for x in left), dict((x[0], x[1:]) for x in right)
    for at, name in ((0, "matched_sync_id"), (1, "matched_key")):
        if strategy == ("natural_key", "sync_id")[at]:
            continue
        sides = defaultdict(list), defaultdict(list)
        for rows, side in zip((l, r), sides):
            for i, ids in rows.items():
                if ids[at] is not None:
                    side[ids[at]].append(i)
        for k in sides[0].keys() & sides[1].keys():
            a, b = min(sides[0][k]), sides[1][k]
            if len(b) > 1 and at == 0:
                continue
            out.append((a, min(b), name if len(b) == 1 else "multi_match"))
            del l[a]
            for i in b:
                del r[i]
    return {*out, *((i, None, "unmatched_source") for i in l), *((None, i, "unmatched_target") for i in r)}


def test_cascade_deals_rows_to_bounded_tasks(spark):
    rng = random.Random(5)
    some = lambda p, n: f"{p}{rng.randrange(n)}" if rng.random() < 0.7 else None
    left, right = ([(i, some("S", 60), some("K", 50)) for i in range(n)] for n in (80, 90))
    l = spark.createDataFrame(left, "lid long, sync_id string, natural_key string")
    r = spark.createDataFrame(right, "rid long, sync_id string, natural_key string")
    for strategy in identity.STRATEGIES:
        assert {tuple(x) for x in identity.cascade(l, r, strategy).collect()} == plain_cascade(left, right, strategy), strategy
    found = identity.cascade(l, r, rows=6 * identity.PART_ROWS)
    assert "lid" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 7), REPARTITION_BY_NUM" in plan


def test_sides_are_staged_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("c_custkey"), F.lit("N").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.5).alias("c_acctbal"), F.lit("S").alias("c_mktsegment"))
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(queries, "STAGE_ROWS", 60)
    for side in queries.sides(spark, str(tmp_path)):
        sizes = [r["count"] for r in side.rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 4 and max(sizes) < 150
    out = queries.apply_convergence(spark, str(tmp_path)).first()
    assert (out["before"], out["after"]) == (4, 0)  # multiples of 89 but of neither 97 nor 101
