"""Tabs of workbooks: re-identification by title and index, synchronisation by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import collapse, prepare


def _loose(c):
    return F.lower(collapse(prepare(c, ascii_only=True)))


def rematch(known: DataFrame, live: DataFrame) -> DataFrame:
    """(file_id, tab_id, matched_index, matched_by) of each known tab (file_id, tab_id, title, tab_index).

    By exact title, else by normalised title if it is unique in the file, else by index; what fits none is unmatched, and a
    title that fits several is ambiguous.
    """
    k = known.select("file_id", "tab_id", "title", "tab_index", _loose(F.col("title")).alias("loose"))
    t = live.select("file_id", F.col("title").alias("l_title"), F.col("tab_index").alias("l_index"), _loose(F.col("title")).alias("l_loose"))
    exact = t.groupBy("file_id", F.col("l_title").alias("title")).agg(F.min("l_index").alias("exact"), F.count(F.lit(1)).alias("n_exact"))
    loose = t.groupBy("file_id", F.col("l_loose").alias("loose")).agg(F.min("l_index").alias("loosely"), F.count(F.lit(1)).alias("n_loose"))
    index = t.groupBy("file_id", F.col("l_index").alias("tab_index")).agg(F.count(F.lit(1)).alias("n_index"))
    both = k.join(exact, ["file_id", "title"], "left").join(loose, ["file_id", "loose"], "left").join(index, ["file_id", "tab_index"], "left")
    how = (
        F.when(F.col("n_exact") == 1, F.lit("title")).when((F.col("n_exact") > 1) | (F.col("n_loose") > 1), F.lit("ambiguous"))
        .when(F.col("n_loose") == 1, F.lit("normalized_title")).when(F.col("n_index") == 1, F.lit("index")).otherwise(F.lit("unmatched"))
    )
    both = both.withColumn("matched_by", how)
    matched = F.when(F.col("matched_by") == "title", F.col("exact")).when(F.col("matched_by") == "normalized_title", F.col("loosely")).when(F.col("matched_by") == "index", F.col("tab_index"))
    return both.select("file_id", "tab_id", matched.alias("matched_index"), "matched_by")


def sync(known: DataFrame, live: DataFrame) -> DataFrame:
    """(file_id, gid, change, title): same, renamed, new or vanished (which blocks the tab), by the tabs' ids."""
    k = known.select("file_id", "gid", F.col("title").alias("old"))
    both = k.join(live.select("file_id", "gid", F.col("title").alias("new")), ["file_id", "gid"], "full_outer")
    change = F.when(F.col("old").isNull(), F.lit("new")).when(F.col("new").isNull(), F.lit("vanished")).when(F.col("old") != F.col("new"), F.lit("renamed")).otherwise(F.lit("same"))
    return both.select("file_id", "gid", change.alias("change"), F.coalesce("new", "old").alias("title"))
