"""Layered verification: fingerprints, dataset digest, bucket digests, rows. Each layer runs only if the one before differs.

Unreadable (quarantined) rows are present: they have a sentinel in the digests, take part in no comparison and are findings
of their own. A side is a snapshot, which is digested as a whole, or a ``RowStore``, whose digests are read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.canon import error_code
from tallyline.operators import merkle
from tallyline.operators.compare import classified, error_finding, findings, keyed_comparison, summary
from tallyline.operators.staging import Snapshot
from tallyline.sources.rowstore import COLUMNS, RowStore
from tallyline.sources.scratch import store


@dataclass
class Verification:
    """result: cached, verified, unreadable (no drift, but rows that can't be compared), drift or blocked; mode: the layer that decided; findings may be None."""

    result: str
    mode: str
    findings: DataFrame | None = None
    rows_compared: int = 0


def parse_domain(domain) -> "F.Column":
    """A predicate from a list of (field, operator, value) triples with prefix ``& | !``; triples in a row are joined by and."""
    ops = {
        "=": lambda c, v: c.isNull() if v is None else c == v, "!=": lambda c, v: c.isNotNull() if v is None else c.isNull() | (c != v),
        "<": lambda c, v: c < v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, ">=": lambda c, v: c >= v,
        "in": lambda c, v: c.isin(*v) if v else F.lit(False), "not in": lambda c, v: c.isNull() | ~c.isin(*v) if v else F.lit(True),
        "like": lambda c, v: F.contains(c, F.lit(v)), "ilike": lambda c, v: F.contains(F.lower(c), F.lit(v.lower())),
    }
    items = list(domain)

    def take(i: int):
        x = items[i]
        if x == "!":
            c, i = take(i + 1)
            return ~F.coalesce(c, F.lit(False)), i
        if x in ("&", "|"):
            a, i = take(i + 1)
            b, i = take(i)
            return (a & b if x == "&" else a | b), i
        name, op, value = x
        if op not in ops:
            raise ValueError(f"unknown operator {op}")
        return ops[op](F.col(name), value), i + 1

    out, i = F.lit(True), 0
    while i < len(items):
        c, i = take(i)
        out = out & c
    return out


def source_unchanged(stored: Mapping, live: Mapping, spec: str) -> bool:
    """Both version and time equal, the same contract, a complete unblocked read stored."""
    same = all(stored.get(k) is not None and stored.get(k) == live.get(k) for k in ("version", "modified"))
    return same and stored.get("spec_version") == spec and bool(stored.get("read_complete")) and not stored.get("blocked")


def fast_path(stored: str, live: str, spec: str) -> Column:
    """``source_unchanged`` and an unchanged target, of structs in many rows: ``stored`` has version, modified, spec_version, read_complete, blocked, count, latest;
    ``live`` has version, modified, count, latest. The target's count and latest change both count: a delete moves only one, an edit only the other."""
    s, v = F.col(stored), F.col(live)
    known = s["version"].isNotNull() & s["modified"].isNotNull() & (s["version"] == v["version"]) & (s["modified"] == v["modified"])
    sound = (s["spec_version"] == spec) & F.coalesce(s["read_complete"], F.lit(False)) & ~F.coalesce(s["blocked"], F.lit(False))
    target = s["count"].eqNullSafe(v["count"]) & s["latest"].eqNullSafe(v["latest"])
    return F.coalesce(known & sound & target, F.lit(False))


def target_fingerprint(df: DataFrame, write_date: str) -> dict:
    r = df.agg(F.count(F.lit(1)).alias("count"), F.max(write_date).alias("max_write_date")).first()
    return {"count": r["count"], "max_write_date": r["max_write_date"]}


def bucket_table(s: Snapshot) -> DataFrame:
    rows = merkle.entries(s.rows, F.col("key"), F.col("h_row"), F.col("state") == "quarantined")
    return merkle.all_buckets(merkle.bucket_digests(rows))


class _Digested:
    """A snapshot whose rows are staged and stored once, with what a ``RowStore`` offers."""

    def __init__(self, s: Snapshot):
        self.stored = store(s.rows.select("bucket", *COLUMNS), "side")

    def digests(self) -> DataFrame:
        rows = merkle.entries(self.stored, F.col("key"), F.col("h_row"), F.col("state") == "quarantined")
        return store(merkle.all_buckets(merkle.bucket_digests(rows)), "digests")

    def unreadable_buckets(self) -> list[int]:
        return [r["bucket"] for r in self.stored.where(F.col("state") == "quarantined").select("bucket").distinct().collect()]

    def rows(self, buckets: list[int]) -> DataFrame:
        return self.stored.where(F.col("bucket").isin(buckets))


def verify(source: Snapshot, target: Snapshot, *, unchanged: bool = False, cached: str | None = None) -> Verification:
    """Verify two staged sides.

    An incomplete read or a blocked side is never compared. ``unchanged`` says that both fingerprints equal those of the
    result ``cached``. Rows are compared in differing buckets only.
    """
    if not (source.read_complete and target.read_complete):
        return Verification("blocked", "read_incomplete")
    if source.blocking:
        return Verification("blocked", "header_blocked")
    if unchanged and cached:
        return Verification(cached, "fingerprint")
    if source.count() == 0 and target.count() > 0:
        return Verification("blocked", "empty_tab")
    return _verify(_Digested(source), _Digested(target), source.columns, source.spec_version, source.uid)


def verify_stored(source: RowStore, target: RowStore, columns, spec: str, uid: str) -> Verification:
    """Verify two stored sides by their stored digests: only rows of differing buckets, or with unreadable rows, are read."""
    if source.count() == 0 and target.count() > 0:
        return Verification("blocked", "empty_tab")
    return _verify(source, target, columns, spec, uid)


def _verify(source, target, columns, spec: str, uid: str) -> Verification:
    left, right = source.digests(), target.digests()
    digests = [merkle.dataset_digest(t, spec, uid).first()["digest"] for t in (left, right)]
    bad = sorted({*source.unreadable_buckets(), *target.unreadable_buckets()})
    if digests[0] == digests[1] and not bad:
        return Verification("verified", "dataset_digest")
    differing = sorted(r["bucket"] for r in merkle.diff_buckets(left, right).collect())
    read = sorted({*differing, *bad})
    a, b = source.rows(read), target.rows(read)
    unread = store(unreadable(a, b), "unreadable")
    keys = unread.select("key")
    a, b = (side.where(F.col("bucket").isin(differing) & (F.col("state") != "quarantined")).select("key", "canon", "h_row").join(keys, "key", "left_anti") for side in (a, b))
    found = store(findings(keyed_comparison(a, b), columns).unionByName(unread.select(*FINDING)), "findings")
    s = summary(found).first()
    result = "unreadable" if s["result"] == "verified" and unread.limit(1).count() else s["result"]
    counts = [t.where(F.col("bucket").isin(read)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (left, right)]
    return Verification(result, "rows", found, rows_compared=sum(counts))


FINDING = ("key", "finding", "field", "delta_class", "source_token", "target_token", "category", "severity")


def unreadable(source: DataFrame, target: DataFrame) -> DataFrame:
    """A finding for each key with an unreadable row on either side: of what kind, in which field, with which tokens.

    Such keys are present, so they are missing on neither side, and equal to nothing, so they are never verified. Of several
    unreadable rows of a key the first by field counts; the source's kind comes before the target's.
    """

    def bad(df: DataFrame, name: str) -> DataFrame:
        token = F.try_element_at("canon", F.col("quarantine_field"))
        what = F.struct(F.coalesce("quarantine_field", F.lit("")).alias("field"), F.coalesce("quarantine_reason", F.lit("")).alias("reason"), token.alias("token"))
        return df.where((F.col("state") == "quarantined") & F.col("key").isNotNull()).groupBy("key").agg(F.min(what).alias(name))

    both = bad(source, "s").join(bad(target, "t"), "key", "full_outer")
    first = F.coalesce("s", "t")
    kind = F.when(first["reason"] == "duplicate_identity", F.lit("duplicate_identity")).otherwise(error_finding(F.coalesce(error_code(first["token"]), F.lit(""))))
    rows = both.select("key", kind.alias("finding"), F.nullif(first["field"], F.lit("")).alias("field"), F.lit(None).cast("string").alias("delta_class"), F.col("s.token").alias("source_token"), F.col("t.token").alias("target_token"))
    return classified(rows).select(*FINDING)
