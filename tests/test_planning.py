"""Staging, planning, guards, breakers, application and convergence."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tallyline.operators import compare, identity, staging
from tallyline.operators.staging import Snapshot
from tallyline.plans import layered, planner
from tallyline.plans.contract import Contract

NOW = datetime(2026, 1, 15, tzinfo=timezone.utc)
COLUMNS = (Contract("code", is_key=True), Contract("name"), Contract("amount", "money"))
UID = "file/0"


def sides(spark, left, right, **target):
    a = spark.createDataFrame(left, "lid long, code string, name string, amount string")
    b = spark.createDataFrame(right, "rid long, code string, name string, amount string")
    source = staging.stage(a, COLUMNS, keep=["lid"])
    staged = staging.stage(b, COLUMNS, side="target", keep=["rid"])
    staged = staged.withColumn("source_dataset", F.lit(UID))
    for n, v in target.items():
        staged = staged.withColumn(n, v)
    return Snapshot(source, COLUMNS, UID), Snapshot(staged, COLUMNS, UID)


LEFT = [(1, "A", "Alpha", "1.00"), (2, "B", "Beta", "2"), (3, "C", "Gamma", "3"), (4, "D", "Delta", "4")]
RIGHT = [(10, "A", "Alpha", "1.00"), (20, "B", "BETA", "2"), (30, "C", "Gamma", "3.50"), (50, "E", "Echo", "5")]


def test_plan(spark):
    p = planner.plan(*sides(spark, LEFT, RIGHT), planner.Policy(), NOW)
    found = {(r["finding"], r["field"], r["delta_class"]) for r in p.findings.collect()}
    assert found == {("field_mismatch", "name", "cosmetic"), ("field_mismatch", "amount", "substantive"), ("missing_in_target", None, None), ("missing_in_source", None, None)}
    actions = {r["action"]: r for r in p.actions.where("action <> 'update'").collect()}
    assert actions["create"]["payload"]["code"] == "D" and actions["create"]["payload"]["source_dataset"] == UID
    deltas = {(r["rid"], d["field"], d["value"]) for r in p.actions.where("action = 'update'").collect() for d in r["deltas"] if d["field"] != "sync_id"}
    assert deltas == {("30", "amount", "3.00")}
    assert p.header["requires_approval"] and not p.header["breaker_tripped"]
    again = planner.plan(*sides(spark, LEFT, RIGHT), planner.Policy(), NOW)
    assert sorted(map(str, p.actions.collect())) == sorted(map(str, again.actions.collect()))
    assert planner.rejected(p.actions).count() == 0
    assert planner.describe(p.actions).count() == p.actions.count()


def test_unreadable_and_duplicate_rows_are_never_written(spark):
    left = [*LEFT, (5, "F", "Bad", "not a number"), (6, "G", "Twice", "1"), (7, "G", "Twice", "1")]
    p = planner.plan(*sides(spark, left, RIGHT), planner.Policy(), NOW)
    kinds = [r["finding"] for r in p.findings.collect()]
    assert kinds.count("duplicate_identity") == 2 and kinds.count("type_coercion") == 1
    assert p.header["blocked"] and p.header["breaker_reason"] == "duplicate_identity"
    assert {r["action"] for r in p.actions.collect()} == {"quarantine"}


def test_incomplete_read_blocks(spark):
    a, b = sides(spark, LEFT[:1], RIGHT)
    a.read_complete = False
    p = planner.plan(a, b, planner.Policy(delete_policy="soft"), NOW)
    assert p.header["breaker_reason"] == "read_incomplete" and p.actions.count() == 0
    assert layered.verify(a, b).result == "blocked"
    empty, full = sides(spark, [], RIGHT)
    assert layered.verify(empty, full).mode == "empty_tab"


def test_delete_guards_one_by_one(spark):
    base = dict(sync_id="S", natural_key="k", has_link=True, identity_source="sync_id", missing_run_count=2, missing_since=datetime(2026, 1, 1))
    schema = "sync_id string, natural_key string, has_link boolean, identity_source string, missing_run_count int, missing_since timestamp_ntz"

    def guard(policy=None, complete=True, blocked=False, **change):
        row = spark.createDataFrame([tuple((base | change).values())], schema)
        return row.select(planner.delete_guard(policy or planner.Policy(delete_policy="soft"), read_complete=complete, blocked=blocked, now=NOW).alias("g")).first()["g"]

    assert guard() is None
    assert guard(planner.Policy()) == "delete_policy"
    assert guard(sync_id=None) == "no_sync_id"
    assert guard(has_link=False) == "no_promotion_link"
    assert guard(complete=False) == "read_incomplete"
    assert guard(blocked=True) == "dataset_blocked"
    assert guard(planner.Policy(delete_policy="soft", identity_strategy="natural_key")) == "natural_key_identity"
    assert guard(identity_source="natural_key") == "row_identity_not_sync_id"
    assert guard(missing_run_count=1) == "quarantine_runs"
    assert guard(missing_since=None) == "never_observed_missing"
    assert guard(missing_since=datetime(2026, 1, 14, 12)) == "quarantine_hours"


def test_refusals(spark):
    p = planner.plan(*sides(spark, LEFT, RIGHT), planner.Policy(dry_run=False), NOW)
    prints = p.header["fingerprints"]
    assert planner.refusal(p, now=NOW, approved=True, now_prints=prints) == ""
    assert planner.refusal(p, now=NOW, approved=False, now_prints=prints) == "not_approved"
    assert planner.refusal(p, now=datetime(2026, 1, 17, tzinfo=timezone.utc), approved=True, now_prints=prints) == "expired"
    assert planner.refusal(p, now=NOW, approved=True, now_prints=prints | {"target_rows": 9}) == "stale"


def test_apply_is_idempotent_and_converges(spark):
    source, target = sides(spark, LEFT, RIGHT)
    p = planner.plan(source, target, planner.Policy(), NOW)
    fields = ["code", "name", "amount"]
    text = F.transform_values("canon", lambda k, t: planner.typed_value(t))
    start = target.rows.select("rid", "sync_id", "source_dataset", F.lit(True).alias("active"), text.alias("values"))
    once = planner.apply(p.actions, start, fields)
    rows = {r["values"]["code"]: r["values"] for r in once.collect()}
    assert rows["C"]["amount"] == "3.00" and rows["B"]["name"] == "BETA" and "D" in rows and len(rows) == 5
    numbered = once.withColumn("rid", F.coalesce("rid", F.lit(99)))
    twice = planner.apply(p.actions, numbered, fields)
    assert sorted(str(r["values"]) for r in twice.collect()) == sorted(str(r["values"]) for r in once.collect())


def test_layers(spark):
    a, b = sides(spark, LEFT, [(i, *r[1:]) for i, r in enumerate(LEFT)])
    assert layered.verify(a, b).mode == "dataset_digest"
    c, d = sides(spark, LEFT, RIGHT)
    v = layered.verify(c, d)
    assert v.mode == "rows" and v.result == "drift" and v.findings.count() == 4
    assert layered.verify(a, b, unchanged=True, cached="verified").mode == "fingerprint"


def test_cascade(spark):
    left = spark.createDataFrame([(1, "S1", "k1"), (2, None, "k2"), (3, "S3", "k3"), (4, None, "k4")], "lid int, sync_id string, natural_key string")
    right = spark.createDataFrame([(1, "S1", "zz"), (2, None, "k2"), (3, None, "k3"), (33, None, "k3"), (5, None, "k5")], "rid int, sync_id string, natural_key string")
    got = {(r["lid"], r["rid"], r["outcome"]) for r in identity.cascade(left, right).collect()}
    assert got == {(1, 1, "matched_sync_id"), (2, 2, "matched_key"), (3, 3, "multi_match"), (4, None, "unmatched_source"), (None, 5, "unmatched_target")}


def test_rounding_and_tolerance(spark):
    def cls(a, b, **o):
        return spark.range(1).select(compare.delta_class(F.lit(a), F.lit(b), Contract("x", "number", **o)).alias("c")).first()["c"]

    assert cls("n:1.00", "n:1.01") == "substantive"
    assert cls("n:1.00", "n:1.01", abs_tol=0.02) == "rounding"
    assert cls("s:It’s", "s:it's") == "cosmetic"
    assert cls("n:1.001", "n:1.005", scale=2) == "rounding"


def test_quarantine_and_sync_ids(spark):
    df = spark.createDataFrame([("A", "x", None), ("", "y", "2"), ("C", "z", "bad")], "code string, name string, amount string")
    got = [(r["identity_source"], r["quarantine_reason"]) for r in staging.stage(df, (Contract("code", is_key=True, required=True), Contract("name"), Contract("amount", "money"))).collect()]
    assert got == [("natural_key", None), ("none", "missing_required"), ("natural_key", "not_a_number")]


def test_domain(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    pick = lambda d: [r["n"] for r in df.where(layered.parse_domain(d)).collect()]
    assert pick([("n", ">", 1), ("s", "!=", "b")]) == [3]
    assert pick(["|", ("n", "=", 1), ("s", "=", None)]) == [1, 3]
    assert pick(["!", ("s", "in", ["a", "b"])]) == [3]


def test_positions_when_ranges_differ_between_executions(spark):
    rows = spark.range(1000).select(F.lit("update").alias("action"), *(F.col("id").cast("string").alias(c) for c in ("key", "lid", "rid")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = planner.with_sequence(rows)
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert sorted(r["position"] for r in out.select("position").collect()) == list(range(1000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
