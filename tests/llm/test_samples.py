"""Bounded samples that frequent keys don't empty."""

import pytest
from pyspark.sql import functions as F

from tallyline.llm.common import bounded_sample


@pytest.mark.parametrize("case", ["one id", "null ids", "all null", "pairs", "plain", "few ids"])
def test_bounded_sample(spark, case):
    """Half the rows under one id, without an id, or all of them; repeated ids go together; the bound is kept and nearly reached."""
    k = F.col("i")
    key = {
        "one id": F.when(k % 2 == 0, F.lit(-1)).otherwise(k), "null ids": F.when(k % 2 == 1, k), "all null": F.lit(None).cast("long"), "pairs": F.floor(k / 2), "plain": k,
        "few ids": k % 37,
    }[case]
    df = spark.range(20_000).withColumnRenamed("id", "i").select("i", key.cast("long").alias("id"), F.concat(F.lit("t"), k.cast("string")).alias("text"), (k % 10 < 2).alias("rare"))
    picked = df.where(bounded_sample(df, F.col("id"), 1000, F.col("rare"), F.col("text"))).collect()
    again = df.repartition(7).where(bounded_sample(df.repartition(3), F.col("id"), 1000, F.col("rare"), F.col("text"))).collect()
    assert sorted(r["i"] for r in picked) == sorted(r["i"] for r in again)
    for rare in (True, False):
        n = sum(r["rare"] is rare for r in picked)
        assert (500 if case == "few ids" else 998) <= n <= 1000
    if case in ("one id", "null ids"):
        assert all(r["i"] % 2 for r in picked)
    if case == "pairs":
        assert len({r["id"] for r in picked}) * 2 == len(picked)
    small = df.where("i < 900")
    assert small.where(bounded_sample(small, F.col("id"), 1000)).count() == 900
