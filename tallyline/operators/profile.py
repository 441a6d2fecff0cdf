"""Column profiles: filled and distinct counts, a sample, the observed kind. Advisory only; types are declared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline import taxonomy as tx

SAMPLE = 10
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def value_kind(v: Column, dtype: str) -> Column:
    """empty, text, number, bool, date_serial or error."""
    if dtype == "boolean":
        return F.when(v.isNull(), F.lit("empty")).otherwise(F.lit("bool"))
    if dtype in _NUMERIC or dtype.startswith("decimal"):
        return F.when(v.isNull(), F.lit("empty")).when((v >= 20000) & (v <= 60000), F.lit("date_serial")).otherwise(F.lit("number"))
    s = v.cast("string")
    return F.when(s.isNull() | (F.trim(s) == ""), F.lit("empty")).when(s.rlike(tx.ERROR_TEXT), F.lit("error")).otherwise(F.lit("text"))


def column_kind(kinds: Column) -> Column:
    """The kind of a column from the set of its values' kinds."""
    some = F.array_except(kinds, F.array(F.lit("empty")))
    numbers = F.forall(some, lambda k: k.isin("number", "date_serial"))
    return (
        F.when(F.size(some) == 0, F.lit("empty")).when(F.size(some) == 1, F.element_at(some, 1)).when(numbers, F.lit("number")).otherwise(F.lit("mixed"))
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """(column, nonempty, distinct, kind[, sample]) of each column; counts are exact, in one pass over long rows.

    Rows become (column, value) pairs, pre-counted before the shuffle, so distinct counting needs no set in memory.
    With ``order``, ``sample`` lists the first ten values by it.
    """
    types = dict(df.dtypes)
    columns = list(columns or [c for c in df.columns if c != order])
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), value_kind(F.col(f"`{c}`"), types[c]).alias("kind"))
    at = F.lit(None).cast("string").alias("at") if order is None else F.col(order).alias("at")
    cells = df.select(at, F.explode(F.array(*map(cell, columns))).alias("c")).select("at", "c.*")
    counted = cells.groupBy("column", "value", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    full = F.col("kind") != "empty"
    out = counted.groupBy("column").agg(
        F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("nonempty"), F.count(F.when(full, F.lit(1))).alias("distinct"), F.collect_set("kind").alias("kinds")
    )
    out = out.select("column", "nonempty", "distinct", column_kind(F.col("kinds")).alias("kind"))
    if order is None:
        return out
    first = samples(df, columns, order)  # one row for each column
    return out.join(F.broadcast(first), "column", "left").withColumn("sample", F.coalesce("sample", F.array().cast("array<string>")))


def samples(df: DataFrame, columns: Sequence[str], order: str, k: int = SAMPLE) -> DataFrame:
    """(column, sample): the first ``k`` filled values of each column by ``order``, in one scan.

    The limit on the row number is applied in each task before the shuffle, which gets ``k`` values of a column from each.
    """
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v"))
    cells = df.select(F.col(order).alias("at"), F.explode(F.array(*map(cell, columns))).alias("c")).select("at", "c.*").where(F.col("v").isNotNull() & (F.trim("v") != ""))
    first = cells.withColumn("n", F.row_number().over(Window.partitionBy("column").orderBy("at", "v"))).where(F.col("n") <= k)
    return first.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias("sample"))
