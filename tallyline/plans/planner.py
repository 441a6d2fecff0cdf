"""Planning and applying: from two snapshots to findings and an ordered, guarded change plan, and from it to a new target.

``plan`` is a pure function of its inputs with an injected clock; preview and application use the same frames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import taxonomy as tx
from tallyline.functions.canon import is_error, payload, tag
from tallyline.functions.identifiers import derived_ulid
from tallyline.operators.compare import classified, field_differences
from tallyline.operators.identity import cascade
from tallyline.operators.staging import Snapshot, join_counts
from tallyline.sources.scratch import store


@dataclass(frozen=True)
class Policy:
    identity_strategy: str = "sync_id_then_key"
    create_allowed: bool = True
    update_allowed: bool = True
    delete_policy: str = "report"
    soft_delete_field: str = "active"
    auto_heal: bool = False
    dry_run: bool = True
    create_threshold_abs: int = 50
    create_threshold_pct: float = 20.0
    delete_threshold_abs: int = 20
    delete_threshold_pct: float = 5.0
    quarantine_runs: int = 2
    quarantine_hours: int = 24
    flap_limit: int = 3
    block_on_quarantine: bool = True
    default_values: Mapping[str, str] = field(default_factory=dict)


@dataclass
class Plan:
    """Frames and the driver's header: counts, breakers, approval, fingerprints."""

    actions: DataFrame
    findings: DataFrame
    header: dict


def structural(source: Snapshot, target: Snapshot) -> list[str]:
    """Reasons that block a comparison, in order of precedence."""
    found = []
    if not (source.read_complete and target.read_complete):
        found.append("read_incomplete")
    if source.count() == 0 and target.count() > 0:
        found.append("empty_tab")
    if source.blocking:
        found.append("header_blocked")
    return found


def structural_findings(datasets: DataFrame) -> DataFrame:
    """(dataset, finding, position) of datasets (dataset, read_complete, blocked, source_rows, target_rows): what blocks their comparison, in order of precedence."""
    reasons = F.array(
        F.when(~F.coalesce("read_complete", F.lit(False)), F.lit("read_incomplete")), F.when((F.col("source_rows") == 0) & (F.col("target_rows") > 0), F.lit("empty_tab")),
        F.when(F.coalesce("blocked", F.lit(False)), F.lit("header_change")),
    )
    return datasets.select("dataset", F.posexplode(F.array_compact(reasons)).alias("position", "finding"))


def delete_guard(policy: Policy, *, read_complete: bool, blocked: bool, now: datetime) -> Column:
    """The first guard that withholds a delete of a target row, null if none does."""
    hours = F.lit(now.astimezone(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz") - F.expr(f"INTERVAL '{policy.quarantine_hours}' HOUR")
    source = F.coalesce("identity_source", F.when(F.col("sync_id").isNotNull(), F.lit("sync_id")), F.when(F.col("natural_key").isNotNull(), F.lit("natural_key")), F.lit("none"))
    ladder = (
        (F.lit(policy.delete_policy != "soft"), "delete_policy"),
        (F.col("sync_id").isNull() | (F.trim("sync_id") == ""), "no_sync_id"),
        (~F.coalesce(F.col("has_link"), F.lit(False)), "no_promotion_link"),
        (F.lit(not read_complete), "read_incomplete"),
        (F.lit(blocked), "dataset_blocked"),
        (F.lit(policy.identity_strategy == "natural_key"), "natural_key_identity"),
        (source != "sync_id", "row_identity_not_sync_id"),
        (F.coalesce(F.col("missing_run_count"), F.lit(0)) < policy.quarantine_runs, "quarantine_runs"),
        (F.col("missing_since").isNull(), "never_observed_missing"),
        (F.col("missing_since").cast("timestamp_ntz") > hours, "quarantine_hours"),
    )
    return F.coalesce(*(F.when(test, F.lit(reason)) for test, reason in ladder))


def breaker_limits(policy: Policy, source_rows: int, target_rows: int) -> tuple[float, float]:
    """Largest numbers of creates and deletes that pass without a human."""
    return (
        max(float(policy.create_threshold_abs), policy.create_threshold_pct / 100.0 * source_rows),
        max(float(policy.delete_threshold_abs), policy.delete_threshold_pct / 100.0 * target_rows),
    )


def typed_value(token: Column) -> Column:
    """A token's value as text for the target; null for empty. Relations and errors have none (see ``is_resolvable``)."""
    return F.when(tag(token).isin(tx.TEXT, tx.SELECTION, tx.NUMBER, tx.DATE, tx.DATETIME), payload(token)).when(token == "b:1", F.lit("true")).when(token == "b:0", F.lit("false"))


def is_resolvable(token: Column) -> Column:
    return ~tag(token).isin(tx.RELATION, tx.ERROR)


def with_sequence(actions: DataFrame) -> DataFrame:
    """Ordered by kind, then by identity; ``position`` and ``batch_index`` (200 actions a batch) without one global sort task.

    Positions come from sorted partitions and their counts, both of one stored table, as ranges differ between executions;
    only a count for each partition comes to the driver.
    """
    order = F.create_map(*(F.lit(x) for k, v in tx.ACTION_SEQUENCE.items() for x in (k, v)))
    out = actions.withColumn("sequence", F.element_at(order, F.col("action")))
    ranged = out.repartitionByRange("sequence", "key", "rid", "lid").sortWithinPartitions("sequence", "key", "rid", "lid")
    numbered = store(ranged.withColumn("__m", F.monotonically_increasing_id()), "plan-sequence")
    counts = {r["p"]: r["n"] for r in numbered.groupBy(F.shiftright("__m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += counts[p]
    base = F.try_element_at(F.create_map(*(F.lit(x) for p, n in starts.items() for x in (p, n))), F.shiftright("__m", 33)) if starts else F.lit(0)
    position = base + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("position", position).withColumn("batch_index", F.floor(F.col("position") / tx.ACTION_BATCH).cast("int")).drop("__m")


def plan(source: Snapshot, target: Snapshot, policy: Policy, now: datetime) -> Plan:
    """Compare two snapshots and plan the target's change.

    ``source.rows`` needs lid, sync_id, natural_key, identity_source, canon, h_row, state, quarantine_reason, key;
    ``target.rows`` needs rid, sync_id, natural_key, canon, h_row, source_dataset and may have has_link, missing_since,
    missing_run_count, identity_source, flap_counters. Order of stages: structure, duplicates, quarantine, matching, fields,
    creates, absences, breakers. Unreadable and duplicate rows are reported, never written. Nothing is ever deleted
    for being absent from an incomplete read.
    """
    columns = [c for c in source.columns if c.ctype != "ignore"]
    reasons = set(structural(source, target))
    left, right = source.rows, target.rows
    for name, kind in (("has_link", "boolean"), ("missing_since", "timestamp"), ("missing_run_count", "int"), ("identity_source", "string"), ("flap_counters", "map<string,int>")):
        if name not in right.columns:
            right = right.withColumn(name, F.lit(None).cast(kind))
    left = store(left.select("lid", "sync_id", "natural_key", "identity_source", "canon", "h_row", "state", "quarantine_field", "quarantine_reason"), "plan-source")
    right = store(right.select("rid", "sync_id", "natural_key", "identity_source", "canon", "h_row", "source_dataset", "has_link", "missing_since", "missing_run_count", "flap_counters"), "plan-target")
    none = F.lit(None)

    def finding(df: DataFrame, kind: Column | str, **values: Column) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        text = lambda n: values.get(n, none).cast("string").alias(n)
        return df.select(kind.alias("finding"), *(text(n) for n in ("key", "lid", "rid", "field", "delta_class", "source_token", "target_token")))

    # Duplicate identities leave both sides first.
    def repeated(by: str) -> DataFrame:
        """The rows whose identity others share; the rows of a frequent one are spread (``join_counts``)."""
        ids = left.select("lid", by)
        n = store(ids.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "plan-counts")
        return join_counts(ids, n, by, "n").where(F.col("n").isNotNull()).select("lid")

    duplicate = store(repeated("sync_id").unionByName(repeated("natural_key")).distinct(), "plan-duplicates")
    found = finding(left.join(duplicate, "lid", "left_semi"), "duplicate_identity", key=F.col("natural_key"), lid=F.col("lid"))
    has_duplicates = bool(duplicate.limit(1).count())
    if has_duplicates:
        reasons.add("duplicate_identity")
    bad = left.where(F.col("state") == "quarantined").join(duplicate, "lid", "left_anti")
    kinds = F.when(F.col("quarantine_reason").isin("identifier_numeric", "orphan_reference", "currency_mismatch"), F.col("quarantine_reason")).otherwise(F.lit("type_coercion"))
    found = found.unionByName(finding(bad, kinds, key=F.col("natural_key"), lid=F.col("lid"), field=F.col("quarantine_field")))
    blocked = bool(reasons & {"read_incomplete", "empty_tab", "header_blocked"}) or has_duplicates or (policy.block_on_quarantine and bool(bad.limit(1).count()))
    clean = left.join(duplicate, "lid", "left_anti").where(F.col("state") != "quarantined")
    matches = store(cascade(clean.select("lid", "sync_id", "natural_key"), right.select("rid", "sync_id", "natural_key"), policy.identity_strategy, source.count() + target.count()), "plan-matches")
    several = matches.where(F.col("outcome") == "multi_match")
    if several.limit(1).count():
        reasons.add("duplicate_identity")
    found = found.unionByName(finding(several.join(clean.select("lid", "natural_key"), "lid"), "multi_match", key=F.col("natural_key"), lid=F.col("lid")))

    lrow, rrow = F.struct("canon", "h_row", "sync_id", "natural_key").alias("l"), F.struct("canon", "h_row", "sync_id", "source_dataset", "flap_counters").alias("r")
    pairs = matches.where(F.col("outcome").isin("matched_sync_id", "matched_key")).select("lid", "rid")
    pairs = pairs.join(clean.select("lid", F.col("natural_key").alias("key"), lrow), "lid").join(right.select("rid", rrow), "rid")
    pairs = store(pairs, "plan-pairs")
    differing = store(field_differences(pairs, columns, keep=("key", "lid", "rid", "r")), "plan-fields")
    found = found.unionByName(finding(differing, F.col("finding"), **{n: F.col(n) for n in ("key", "lid", "rid", "field", "delta_class", "source_token", "target_token")}))
    authority = F.create_map(*(F.lit(x) for c in columns for x in (c.key, c.authority)))
    writable = (F.col("finding") == "field_mismatch") & (F.col("delta_class") == "substantive") & (F.element_at(authority, F.col("field")) == "source")
    writable = writable & F.lit(policy.update_allowed and not blocked)
    flapping = F.coalesce(F.try_element_at("r.flap_counters", F.col("field")), F.lit(0)) >= policy.flap_limit
    stopped = differing.where(writable & flapping)
    found = found.unionByName(finding(stopped, "non_convergent", **{n: F.col(n) for n in ("key", "lid", "rid", "field", "source_token", "target_token")}))
    opaque = differing.where(writable & ~flapping & ~is_resolvable(F.col("source_token")))
    found = found.unionByName(finding(opaque, "type_coercion", **{n: F.col(n) for n in ("key", "lid", "rid", "field", "source_token", "target_token")}))
    delta = F.struct(F.col("field"), F.col("target_token").alias("from"), F.col("source_token").alias("to"), typed_value(F.col("source_token")).alias("value"))
    writes = differing.where(writable & ~flapping & is_resolvable(F.col("source_token"))).select("lid", "rid", delta.alias("delta"))
    # A record matched by key without an identity of its own is stamped with one.
    ms = int(now.timestamp() * 1000)
    minted = lambda key: derived_ulid(ms, F.lit(source.uid), key)
    stamp = pairs.where(F.col("r.sync_id").isNull()).withColumn("id", F.coalesce("l.sync_id", minted(F.col("key"))))
    stamped = stamp.select("lid", "rid", F.struct(F.lit("sync_id").alias("field"), F.lit(tx.NULL).alias("from"), F.concat(F.lit(tx.TEXT), "id").alias("to"), F.col("id").alias("value")).alias("delta"))
    owner = pairs.where(F.coalesce("r.source_dataset", F.lit("")) == "") if source.uid else pairs.limit(0)
    owned = owner.select("lid", "rid", F.struct(F.lit("source_dataset").alias("field"), F.lit(tx.NULL).alias("from"), F.lit(tx.TEXT + source.uid).alias("to"), F.lit(source.uid).alias("value")).alias("delta"))
    if blocked:
        stamped, owned = stamped.limit(0), owned.limit(0)
    deltas = writes.unionByName(stamped).unionByName(owned).groupBy("lid", "rid").agg(F.array_sort(F.collect_list("delta")).alias("deltas"))

    shape = lambda df, action, **v: df.select(
        F.lit(action).alias("action"), v.get("key", none).cast("string").alias("key"), v.get("lid", none).cast("string").alias("lid"), v.get("rid", none).cast("string").alias("rid"),
        v.get("sync_id", none).cast("string").alias("sync_id"), v.get("payload", F.create_map().cast("map<string,string>")).alias("payload"),
        v.get("deltas", F.array().cast("array<struct<field:string,from:string,to:string,value:string>>")).alias("deltas"),
    )
    updates = deltas.join(pairs.select("lid", "rid", "key", F.coalesce("r.sync_id", "l.sync_id", minted(F.col("key"))).alias("sid")), ["lid", "rid"])
    actions = shape(updates, "update", key=F.col("key"), lid=F.col("lid"), rid=F.col("rid"), sync_id=F.col("sid"), deltas=F.col("deltas"))

    new = clean.join(matches.where(F.col("outcome") == "unmatched_source").select("lid"), "lid", "left_semi")
    found = found.unionByName(finding(new, "missing_in_target", key=F.col("natural_key"), lid=F.col("lid")))
    found = found.unionByName(finding(new.where(F.col("identity_source") == "none"), "duplicate_identity", key=F.col("natural_key"), lid=F.col("lid")))
    if not blocked and policy.create_allowed:
        able = new.where(F.col("identity_source") != "none").withColumn("sid", F.coalesce("sync_id", minted(F.coalesce("natural_key", F.col("lid").cast("string")))))
        from_source = [c.key for c in columns if c.authority == "source"]
        kept = F.map_filter("canon", lambda k, t: k.isin(*from_source) & is_resolvable(t)) if from_source else F.create_map().cast("map<string,string>")
        values = F.transform_values(kept, lambda k, t: typed_value(t))
        marks = F.map_from_arrays(F.array(F.lit("sync_id"), F.lit("source_dataset")), F.array(F.col("sid"), F.lit(source.uid)))
        given = {k for k in policy.default_values} - {c.key for c in columns}
        defaults = F.create_map(*(F.lit(x) for k in sorted(given) for x in (k, str(policy.default_values[k])))) if given else F.create_map().cast("map<string,string>")
        actions = actions.unionByName(shape(able, "create", key=F.col("natural_key"), lid=F.col("lid"), sync_id=F.col("sid"), payload=F.map_concat(defaults, values, marks)))

    gone = right.join(matches.where(F.col("outcome") == "unmatched_target").select("rid"), "rid", "left_semi")
    owned_here = F.coalesce(F.col("source_dataset") == source.uid, F.lit(False)) & F.lit(bool(source.uid))
    found = found.unionByName(finding(gone.where(~owned_here), "unmanaged_record", key=F.col("natural_key"), rid=F.col("rid")))
    absent = gone.where(owned_here)
    found = found.unionByName(finding(absent, "missing_in_source", key=F.col("natural_key"), rid=F.col("rid")))
    guard = delete_guard(policy, read_complete=source.read_complete and target.read_complete, blocked=blocked, now=now)
    doomed = absent.where(guard.isNull())
    actions = actions.unionByName(shape(doomed, "soft_delete", key=F.col("natural_key"), rid=F.col("rid"), sync_id=F.col("sync_id"), payload=F.create_map(F.lit(policy.soft_delete_field), F.lit("false"))))
    quarantine = bad.select("lid", "natural_key", "quarantine_reason").unionByName(several.join(clean.select("lid", "natural_key"), "lid").select("lid", "natural_key", F.lit("multi_match").alias("quarantine_reason")))
    actions = actions.unionByName(shape(quarantine, "quarantine", key=F.col("natural_key"), lid=F.col("lid"), payload=F.create_map(F.lit("quarantine_reason"), F.col("quarantine_reason"))))
    actions = store(actions.withColumn("state", F.lit("pending")), "plan-actions")

    counts = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    creates, deletes = breaker_limits(policy, source.count(), target.count())
    if counts.get("soft_delete", 0) > deletes:
        reasons.add("deletes_exceed_threshold")
    if counts.get("create", 0) > creates:
        reasons.add("creates_exceed_threshold")
    header = {
        "counts": counts, "source_rows": source.count(), "target_rows": target.count(), "read_complete": source.read_complete and target.read_complete, "blocked": blocked,
        "breaker_tripped": bool(reasons), "breaker_reason": next((b for b in tx.BREAKERS if b in reasons), ""),
        "requires_approval": bool(reasons or counts.get("soft_delete") or not policy.auto_heal), "dry_run": policy.dry_run, "created": now,
        "fingerprints": fingerprints(source, target),
    }
    return Plan(actions, classified(found), header)


def fingerprints(source: Snapshot, target: Snapshot) -> dict:
    return {"spec_version": source.spec_version, "source_rows": source.count(), "target_rows": target.count(), "max_write_date": target.max_write_date, "uid": source.uid}


def is_stale(header: Mapping, now_prints: Mapping) -> list[str]:
    """The names of set fingerprints that differ now."""
    return [k for k, v in header["fingerprints"].items() if v not in (None, "") and now_prints.get(k) != v]


def refusal(plan: Plan, *, now: datetime, approved: bool, now_prints: Mapping, hours: int = 24) -> str:
    """Why a plan may not be applied, '' if it may: dry run, expiry, staleness, breaker, approval."""
    h = plan.header
    if h["dry_run"]:
        return "dry_run"
    if (now - h["created"]).total_seconds() > hours * 3600:
        return "expired"
    if is_stale(h, now_prints):
        return "stale"
    if h["blocked"]:
        return "blocked"
    if h["breaker_tripped"] and not approved:
        return "breaker"
    if h["requires_approval"] and not approved:
        return "not_approved"
    return ""


def apply(actions: DataFrame, target: DataFrame, fields: Sequence[str], soft_delete_field: str = "active") -> DataFrame:
    """The target after the pending actions: (rid, sync_id, source_dataset, active, values map of text).

    Idempotent: creates are keyed by their sync id, updates set values, deletes clear a flag. ``target`` has rid (long),
    sync_id, source_dataset, active and values; new rows have a null rid until the target assigns one.
    """
    todo = actions.where(F.col("state") == "pending")
    up = todo.where(F.col("action") == "update").select(F.col("rid").cast("bigint").alias("rid"), F.map_from_entries(F.transform("deltas", lambda d: F.struct(d["field"], d["value"]))).alias("set"))
    down = todo.where(F.col("action") == "soft_delete").select(F.col("rid").cast("bigint").alias("rid"), F.lit(True).alias("gone"))
    out = target.join(up, "rid", "left").join(down, "rid", "left")
    given = F.coalesce("set", F.create_map().cast("map<string,string>"))
    merged = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.when(F.map_contains_key(given, F.lit(f)), F.try_element_at(given, F.lit(f))).otherwise(F.try_element_at("values", F.lit(f))) for f in fields)))
    changed = out.select(
        "rid", F.coalesce(F.try_element_at(given, F.lit("sync_id")), "sync_id").alias("sync_id"), F.coalesce(F.try_element_at(given, F.lit("source_dataset")), "source_dataset").alias("source_dataset"),
        (F.col("active") & F.col("gone").isNull()).alias("active"), merged.alias("values"),
    )
    born = todo.where(F.col("action") == "create").join(target.select("sync_id").where(F.col("sync_id").isNotNull()), "sync_id", "left_anti")
    value = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.try_element_at("payload", F.lit(f)) for f in fields)))
    new = born.select(F.lit(None).cast("bigint").alias("rid"), "sync_id", F.try_element_at("payload", F.lit("source_dataset")).alias("source_dataset"), F.lit(True).alias("active"), value.alias("values"))
    return changed.unionByName(new)


def describe(actions: DataFrame) -> DataFrame:
    """One line of text for each action."""
    change = F.array_join(F.transform("deltas", lambda d: F.concat(d["field"], F.lit(": "), d["from"], F.lit(" -> "), d["to"])), "; ")
    line = (
        F.when(F.col("action") == "update", F.concat(F.lit("Update record "), "rid", F.lit(": "), change)).when(F.col("action") == "create", F.concat(F.lit("Create record "), "sync_id"))
        .when(F.col("action") == "soft_delete", F.concat(F.lit("Archive record "), "rid")).otherwise(F.concat(F.lit("Quarantine row "), F.coalesce("lid", F.lit("?"))))
    )
    return actions.select("action", "key", line.alias("line"))


def rejected(actions: DataFrame) -> DataFrame:
    """Actions that break the plan's integrity: deletes that do more than clear flags, updates and deletes without a record, creates without an id."""
    only_flags = F.forall(F.map_values("payload"), lambda v: v == "false")
    bad = F.when(~F.col("action").isin(*tx.ACTION_SEQUENCE), F.lit("unknown_action")).when((F.col("action") == "soft_delete") & ~only_flags, F.lit("delete_writes_values"))
    bad = bad.when(F.col("action").isin("update", "soft_delete") & F.col("rid").isNull(), F.lit("no_record")).when((F.col("action") == "create") & F.col("sync_id").isNull(), F.lit("no_sync_id"))
    return actions.withColumn("reject", bad).where(F.col("reject").isNotNull())
