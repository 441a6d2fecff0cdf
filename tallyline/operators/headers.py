"""Headers of many datasets as arrays: slugs, occurrence names, gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.plans.contract import occurrence_headers, slugify_all


@F.pandas_udf(T.ArrayType(T.StringType()))
def slugs(headers: pd.Series) -> pd.Series:
    """Slugs by position of each array of headers (nulls as empty); later equal ones get the next free suffix."""
    return headers.map(lambda h: slugify_all([x or "" for x in h]), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def occurrences(headers: pd.Series) -> pd.Series:
    """Collision-free canonical headers of each array."""
    return headers.map(lambda h: occurrence_headers(list(h)), na_action="ignore")


def gates(bound: DataFrame) -> DataFrame:
    """(dataset_id, missing, extra, blocked) of bound headers (``worklist.bind_headers``): declared columns that aren't live block staging, others are growth."""
    names = lambda status: F.array_sort(F.array_agg(F.when(F.col("status") == status, F.col("header"))))
    out = bound.groupBy("dataset_id").agg(F.array_compact(names("missing")).alias("missing"), F.array_compact(names("extra")).alias("extra"))
    return out.withColumn("blocked", F.size("missing") > 0)
