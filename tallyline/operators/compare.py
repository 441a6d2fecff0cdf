"""Comparison of two staged sides: guarded full outer join, field differences, their classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import taxonomy as tx
from tallyline.functions.canon import error_code, folded, is_error, payload, tag
from tallyline.plans.contract import Contract
from tallyline.sources.scratch import store

ROUNDING_STEPS = "0.51"


def keyed_comparison(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """(key, status, l, r): one row for each key of two sides.

    status: matched, missing_in_target, missing_in_source, duplicate_identity (several source rows) or multi_match
    (several target rows). Duplicates are settled first and take part in no comparison; a key with several target rows
    counts as present for the source. ``l`` and ``r`` hold the sides' rows where they are single. Each side is
    aggregated by key and joined with the same partitioning: one shuffle a side. Rows without a key take no part;
    they go after the join, where the test doesn't repeat the key's expression in the scan.
    """

    def one(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.first(F.struct(*rest)).alias(name))

    both = one(left, "l").join(one(right, "r"), key, "full_outer").where(F.col(key).isNotNull())
    status = (
        F.when(F.col("l_n") > 1, F.lit("duplicate_identity")).when(F.col("r_n") > 1, F.lit("multi_match"))
        .when(F.col("r_n").isNull(), F.lit("missing_in_target")).when(F.col("l_n").isNull(), F.lit("missing_in_source")).otherwise(F.lit("matched"))
    )
    single = lambda n: F.when(F.col(f"{n}_n") == 1, F.col(n)).alias(n)
    return both.select(key, status.alias("status"), single("l"), single("r"), F.coalesce("l_n", F.lit(0)).alias("l_n"), F.coalesce("r_n", F.lit(0)).alias("r_n"))


def delta_class(a: Column, b: Column, c: Contract) -> Column:
    """cosmetic, rounding or substantive, of two differing readable tokens. Tolerance only ever downgrades."""
    # Only text columns may hold what Python has to fold.
    ascii_only = c.ascii_only or c.ctype != "text"
    cosmetic = folded(a, ascii_only) == folded(b, ascii_only)
    x, y = payload(a).try_cast("decimal(38,18)"), payload(b).try_cast("decimal(38,18)")
    gap = F.abs(x - y)
    step = F.lit(f"{10.0 ** -(c.scale or 0):.12f}").cast("decimal(20,12)") * F.lit(ROUNDING_STEPS).cast("decimal(3,2)")
    near = gap <= step
    if c.rel_tol or c.abs_tol:
        fx, fy = x.cast("double"), y.cast("double")
        near = near | (F.abs(fx - fy) <= F.greatest(F.lit(float(c.rel_tol)) * F.greatest(F.abs(fx), F.abs(fy)), F.lit(float(c.abs_tol))))
    both_numbers = (tag(a) == tx.NUMBER) & (tag(b) == tx.NUMBER)
    return F.when(cosmetic, F.lit("cosmetic")).when(both_numbers & F.coalesce(near, F.lit(False)), F.lit("rounding")).otherwise(F.lit("substantive"))


def _keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, same) of all keys of both sides: whether their comparison can show nothing.

    It can if the key is on one side only, repeated, of different hashes or with an unreadable token. Of each side a key, a hash and a flag
    are shuffled, never the rows' tokens.
    """

    def slim(df: DataFrame, name: str) -> DataFrame:
        bad = F.exists(F.map_values("canon"), is_error)
        parts = [F.max(F.conv(F.substring("h_row", 1 + 11 * i, 11), 16, 10).cast("bigint")).alias(f"{name}_{i}") for i in range(3)]
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_n"), *parts, F.max(bad).alias(f"{name}_bad"))

    both = slim(left, "l").join(slim(right, "r"), key, "full_outer").where(F.col(key).isNotNull())
    same = (F.col("l_n") == 1) & (F.col("r_n") == 1) & ~F.col("l_bad") & ~F.col("r_bad")
    for i in range(3):
        same = same & (F.col(f"l_{i}") == F.col(f"r_{i}"))
    return both.select(key, F.coalesce(same, F.lit(False)).alias("same"))


def unequal_keys(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    return _keys(left, right, key).where(~F.col("same")).select(key)


def unequal_comparison(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """``keyed_comparison`` of the unequal keys alone, for large sides that mostly agree: stored sides are read twice, but only
    the rows of unequal keys are moved whole."""
    keys = store(unequal_keys(left, right, key), "unequal")
    return keyed_comparison(left.join(keys, key, "left_semi"), right.join(keys, key, "left_semi"), key)


def outcomes(left: DataFrame, right: DataFrame, columns: Sequence[Contract], key: str = "key") -> DataFrame:
    """(outcome, n): how many keys of two stored sides are equal, differ at worst in a class, or have another status.

    Equal keys are counted by their hashes; tokens of the others only are moved and compared.
    """
    keys = store(_keys(left, right, key), "keys")
    unequal = keys.where(~F.col("same")).select(key)
    both = keyed_comparison(left.join(unequal, key, "left_semi"), right.join(unequal, key, "left_semi"), key)
    outcome = F.when(F.col("status") != "matched", F.col("status")).otherwise(F.coalesce(worst_difference(columns), F.lit("equal")))
    found = both.select(outcome.alias("outcome"), F.lit(1).cast("bigint").alias("n")).unionByName(keys.where("same").select(F.lit("equal").alias("outcome"), F.lit(1).cast("bigint").alias("n")))
    return found.groupBy("outcome").agg(F.sum("n").alias("n"))


def error_finding(code: Column) -> Column:
    """The finding that an error token's code stands for."""
    own = ("identifier_numeric", "orphan_reference", "multi_match", "currency_mismatch")
    return F.when(F.lower(code).isin(*own), F.lower(code)).otherwise(F.lit("type_coercion"))


def difference_array(columns: Sequence[Contract]) -> Column:
    """The differing fields of a pair (``l``, ``r``) as an array of structs; see ``field_differences``."""
    parts = []
    for c in columns:
        if c.ctype == "ignore":
            continue
        a = F.coalesce(F.try_element_at("l.canon", F.lit(c.key)), F.lit(tx.NULL))
        b = F.coalesce(F.try_element_at("r.canon", F.lit(c.key)), F.lit(tx.NULL))
        bad = is_error(a) | is_error(b)
        kind = F.when(~bad, F.lit("field_mismatch")).otherwise(error_finding(F.coalesce(error_code(a), error_code(b))))
        parts.append(F.when((a != b) | bad, F.struct(
            F.lit(c.key).alias("field"), a.alias("source_token"), b.alias("target_token"), kind.alias("finding"),
            F.when(~bad, delta_class(a, b, c)).alias("delta_class"),
        )))
    return F.array_compact(F.array(*parts))


def worth_comparing() -> Column:
    """Whether a pair's fields can differ: unequal row hashes, or an unreadable token."""
    return ~(F.col("l.h_row") == F.col("r.h_row")) | F.exists(F.map_values("l.canon"), is_error)


def field_differences(pairs: DataFrame, columns: Sequence[Contract], keep: Sequence[str] = ("key",)) -> DataFrame:
    """(keep..., field, source_token, target_token, finding, delta_class): the differing fields of pairs (``l``, ``r``).

    Pairs with equal row hashes are skipped unseen. An error on either side is reported by its kind, never compared.
    """
    return pairs.where(worth_comparing()).select(*keep, F.explode(difference_array(columns)).alias("d")).select(*keep, "d.*")


def worst_difference(columns: Sequence[Contract]) -> Column:
    """The last delta class by name of a pair's differing fields (substantive over rounding over cosmetic); null if none differs.

    To be taken of pairs that are ``worth_comparing``; where other columns than ASCII ones are folded, Python sees all rows it is taken of.
    """
    return F.when(worth_comparing(), F.array_max(F.transform(difference_array(columns), lambda d: d["delta_class"])))


def findings(comparison: DataFrame, columns: Sequence[Contract]) -> DataFrame:
    """All findings of a keyed comparison: (key, finding, field, delta_class, source_token, target_token, category, severity)."""
    null = F.lit(None).cast("string")
    rows = comparison.where(F.col("status") != "matched").select("key", F.col("status").alias("finding"), null.alias("field"), null.alias("delta_class"), null.alias("source_token"), null.alias("target_token"))
    fields = field_differences(comparison.where(F.col("status") == "matched"), columns).select("key", "finding", "field", "delta_class", "source_token", "target_token")
    return classified(rows.unionByName(fields))


def classified(found: DataFrame) -> DataFrame:
    """With category and default severity; an unknown finding is an error."""
    kinds = F.create_map(*(F.lit(x) for k, v in tx.FINDINGS.items() for x in (k, v[0])))
    levels = F.create_map(*(F.lit(x) for k, v in tx.FINDINGS.items() for x in (k, v[1])))
    known = F.when(F.col("finding").isin(*tx.FINDINGS), F.col("finding")).otherwise(F.raise_error(F.concat(F.lit("unknown finding "), F.col("finding"))).cast("string"))
    return found.withColumn("category", F.element_at(kinds, known)).withColumn("severity", F.element_at(levels, F.col("finding")))


def summary(found: DataFrame) -> DataFrame:
    """One row: findings by category and the result; categories are disjoint."""
    n = lambda c: F.count_if(F.col("category") == c).alias(f"{c}_count")
    out = found.agg(n("drift"), n("data_quality"), n("structural"), F.count_if(F.col("severity") == "blocking").alias("blocking"))
    result = F.when(F.col("blocking") > 0, F.lit("blocked")).when(F.col("drift_count") > 0, F.lit("drift")).otherwise(F.lit("verified"))
    return out.select("drift_count", "data_quality_count", "structural_count", result.alias("result"))


def control_totals(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, source_total, target_total, difference): exact sums of raw values; unreadable ones are skipped.

    Raw on purpose: a mistake that canonicalizes both sides alike shows here alone.
    """
    from tallyline.functions.numbers import raw_decimal

    def totals(df: DataFrame, name: str) -> DataFrame:
        sums = df.agg(*(F.coalesce(F.sum(raw_decimal(F.col(f"`{c}`"))), F.lit(0)).cast("decimal(38,18)").alias(c) for c in columns))
        return sums.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(f"`{c}`"))))).alias("column", name))

    out = totals(left, "source_total").join(totals(right, "target_total"), "column")
    return out.withColumn("difference", (F.col("source_total") - F.col("target_total")).cast("decimal(38,18)"))
