"""Identity: the two-pass cascade, references, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.sources.scratch import store

#: Rows of both sides for each partition of the cascade's joins.
PART_ROWS = 200_000
STRATEGIES = ("sync_id", "natural_key", "sync_id_then_key")


def cascade(left: DataFrame, right: DataFrame, strategy: str = "sync_id_then_key", rows: int | None = None) -> DataFrame:
    """(lid, rid, outcome): sync ids first, then natural keys among the rest. ``lid`` and ``rid`` are unique row ids.

    outcome: matched_sync_id, matched_key, multi_match (a source row whose key fits several target rows; they are
    consumed and never created or deleted), unmatched_source, unmatched_target. Ambiguous sync ids (repeated on a side) go
    on to the second pass; ambiguous source keys pair with their target row by the least source id. Each pass is stored, and
    the number of partitions follows from ``rows`` (of both sides, counted if not given), so that a task sorts a bounded number of rows.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    parts = (left.count() + right.count() if rows is None else rows) // PART_ROWS + 1
    l0 = left.select("lid", "sync_id", "natural_key").repartition(parts, "lid")
    r0 = right.select("rid", F.col("sync_id").alias("r_sync"), F.col("natural_key").alias("r_key")).repartition(parts, "rid")

    def without(df: DataFrame, by: str, *taken: DataFrame) -> DataFrame:
        """The rows of ``df`` that none of ``taken`` has."""
        ids = taken[0].select(by)
        for t in taken[1:]:
            ids = ids.unionByName(t.select(by))
        return df.join(ids.repartition(parts, by), by, "left_anti")

    def paired(l: DataFrame, r: DataFrame, lk: str, rk: str, tag: str) -> DataFrame:
        """(lid, rid, r_key, n): of each key that both sides have the least ids, and how many target rows have it."""
        of_l = l.where(F.col(lk).isNotNull()).groupBy(F.col(lk).alias("k")).agg(F.min("lid").alias("lid")).repartition(parts, "k")
        of_r = r.where(F.col(rk).isNotNull()).groupBy(F.col(rk).alias("k")).agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n")).repartition(parts, "k")
        return store(of_l.join(of_r, "k").select("lid", "rid", F.col("k").alias("r_key"), "n"), tag)

    l1, r1, taken = l0, r0, []
    found = None
    if strategy != "natural_key":
        first = paired(l0, r0, "sync_id", "r_sync", "cascade").where(F.col("n") == 1)
        found = first.select("lid", "rid", F.lit("matched_sync_id").alias("outcome"))
        l1, r1, taken = without(l0, "lid", first), without(r0, "rid", first), [first]
    if strategy != "sync_id":
        second = paired(l1, r1, "natural_key", "r_key", "cascade")
        one = F.col("n") == 1
        outcome = F.when(one, F.lit("matched_key")).otherwise(F.lit("multi_match"))
        matched = second.select("lid", "rid", outcome.alias("outcome"))
        found = matched if found is None else found.unionByName(matched)
        l1 = without(l0, "lid", *taken, second)
        r1 = without(without(r0, "rid", *taken, second.where(one)).repartition(parts, "r_key"), "r_key", second.where(~one))
    null = F.lit(None)
    return found.unionByName(l1.select("lid", null.cast(dict(r0.dtypes)["rid"]).alias("rid"), F.lit("unmatched_source").alias("outcome"))).unionByName(
        r1.select(null.cast(dict(l0.dtypes)["lid"]).alias("lid"), "rid", F.lit("unmatched_target").alias("outcome"))
    )


def resolve_references(df: DataFrame, column: str, lookup: DataFrame, id_col: str, match_field: str, out: str) -> DataFrame:
    """``df`` with the business key of the row that ``column`` refers to; null if there is none."""
    pairs = lookup.groupBy(F.col(id_col).alias("__id")).agg(F.min(match_field).alias(out))
    return df.join(pairs, df[column] == pairs["__id"], "left").drop("__id")


def ownership(links: DataFrame, target: DataFrame) -> DataFrame:
    """(res_id, dataset, old_state, state): a link whose record is gone or carries another owner is unmanaged; a restored one is linked again."""
    t = target.select(F.col("res_id").alias("t_id"), F.col("sync_id").alias("t_sync"), F.col("source_dataset").alias("t_owner"))
    both = links.join(t, links["res_id"] == t["t_id"], "left")
    held = F.col("t_id").isNotNull() & F.col("t_sync").eqNullSafe(F.col("sync_id")) & F.col("t_owner").eqNullSafe(F.col("dataset"))
    state = F.when(~held, F.lit("unmanaged")).when(F.col("state") == "unmanaged", F.lit("linked")).otherwise(F.col("state"))
    return both.select("res_id", "dataset", F.col("state").alias("old_state"), state.alias("state"))


def next_link(link: Column, *, promoted: Column, seen: Column, complete: Column, deleted: Column) -> Column:
    """The next state of a promotion link from what the run saw; an incomplete read changes nothing."""
    return (
        F.when(deleted, F.lit("soft_deleted")).when(promoted | (seen & link.isin("missing", "linked")), F.lit("linked"))
        .when(~seen & complete & (link == "linked"), F.lit("missing")).otherwise(link)
    )
