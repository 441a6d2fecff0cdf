"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on one machine (tests), a temporary folder is made and set; elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallyline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write once, read back: later stages start from a scan, and a lost executor loses nothing."""
    path = f"{folder(df.sparkSession)}/tallyline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` over tasks of some ``rows`` rows: before costly expressions, as one split of a file may hold millions of short rows. Counts ``df``."""
    return df.repartition(df.count() // rows + 1, *by)
