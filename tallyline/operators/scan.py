"""Running values along each key's rows, where one key may hold a large part of them.

Rows of most keys are ordered by a window, one task a key. Frequent keys, counted first, are cut into segments: their rows are dealt by
ranges of (key, order), every segment of a key is scanned by itself and summed up in one row, and what comes over from the
segments before is worked out over these summaries, as many as there are ranges and frequent keys together. So the rows of a
key that holds half a table are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyline.sources.scratch import store

#: Keys of more than 1/HOT of the rows are frequent, so fewer than HOT; below LEAST rows none is.
HOT, LEAST = 500, 100_000


def _split(rows: DataFrame, keys: Sequence[str], least: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of frequent keys apart from the others; fewer than HOT keys are broadcast."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    if total < least:
        return rows, None
    hot = store(counts.where(F.col("__n") > F.lit(total / HOT)).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))), "frequent")
    if not hot.limit(1).count():
        return rows, None
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(F.broadcast(hot), same, "left_anti"), rows.join(F.broadcast(hot), same, "left_semi")


def _scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], local: Callable[[DataFrame, WindowSpec], DataFrame], summary: Sequence[Column],
    carry: Callable[[DataFrame, WindowSpec], DataFrame], out: Column, least: int,
) -> DataFrame:
    """``local`` adds running values within a window; of each segment ``summary`` is kept, to which ``carry`` adds ``__carry``, what comes over from the
    summaries before; ``out`` puts it (null: nothing) and the local values together as ``__out``."""
    cold, hot = _split(store(df, "scan"), keys, least)
    found = local(cold, Window.partitionBy(*keys).orderBy(*order)).withColumn("__carry", F.lit(None).cast("bigint"))
    if hot is not None:
        dealt = hot.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__seg", F.spark_partition_id())
        parts = store(local(store(dealt, "segments"), Window.partitionBy("__seg", *keys).orderBy(*order)), "segments")
        # A summary for each segment of a frequent key: bounded by the ranges and HOT.
        before = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
        sums = carry(parts.groupBy("__seg", *keys).agg(*summary), before)
        sums = sums.select(F.col("__seg").alias("__s"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__carry").cast("bigint").alias("__carry"))
        same = F.col("__seg") == F.col("__s")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        found = found.unionByName(parts.join(F.broadcast(sums), same).select(*found.columns))
    return found.withColumn("__out", out)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, least: int = LEAST) -> DataFrame:
    """With ``name``: the number of each row among its key's, from 1. Rows that tie in ``order`` are numbered in any order."""
    local = lambda rows, w: rows.withColumn("__v", F.row_number().over(w).cast("bigint"))
    carry = lambda sums, before: sums.withColumn("__carry", F.sum("__rows").over(before))
    out = _scan(df, keys, order, local, [F.count(F.lit(1)).alias("__rows")], carry, F.col("__v") + F.coalesce("__carry", F.lit(0)), least)
    return out.select(*df.columns, F.col("__out").alias(name))


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, name: str, least: int = LEAST) -> DataFrame:
    """With ``name``: how many rows in a row, up to this one, the condition held (null is no)."""
    rows = df.withColumn("__hit", F.coalesce(hit, F.lit(False)))

    def local(part: DataFrame, w: WindowSpec) -> DataFrame:
        placed = part.withColumn("__at", F.row_number().over(w).cast("bigint"))
        return placed.withColumn("__miss", F.max(F.when(~F.col("__hit"), F.col("__at"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def carry(sums: DataFrame, before: WindowSpec) -> DataFrame:
        # The rows of all segments before, less those up to the last miss in them.
        counted = sums.withColumn("__b", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        return counted.withColumn("__m", F.max(F.col("__last") + F.col("__b")).over(before)).withColumn("__carry", F.col("__b") - F.coalesce("__m", F.lit(0)))

    out = F.when(F.col("__miss").isNull(), F.col("__at") + F.coalesce("__carry", F.lit(0))).otherwise(F.col("__at") - F.col("__miss"))
    found = _scan(rows, keys, order, local, [F.count(F.lit(1)).alias("__rows"), F.max("__miss").alias("__last")], carry, out, least)
    return found.select(*df.columns, F.col("__out").alias(name))


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, least: int = LEAST) -> DataFrame:
    """With ``name``: the last non-null value (a long) of the rows before this one."""
    rows = df.withColumn("__x", value.cast("bigint"))

    def local(part: DataFrame, w: WindowSpec) -> DataFrame:
        earlier = part.withColumn("__v", F.last("__x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        return earlier.withColumn("__upto", F.coalesce("__x", "__v"))

    carry = lambda sums, before: sums.withColumn("__carry", F.last("__end", ignorenulls=True).over(before))
    found = _scan(rows, keys, order, local, [F.max_by("__upto", F.struct(*order)).alias("__end")], carry, F.coalesce("__v", "__carry"), least)
    return found.select(*df.columns, F.col("__out").alias(name))
