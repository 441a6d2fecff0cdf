"""What to stage next, how live headers meet contracts, and which cached digests still hold."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.text import join_key
from tallyline.plans.contract import ContractError, build, spec_version, validate
from tallyline.sources import scratch


def due_tabs(tabs: DataFrame, files: DataFrame, fingerprints: DataFrame, connection: str | None = None) -> DataFrame:
    """(file_id, position, gid) of the tabs to stage, numbered within their file by tab index.

    A tab is due if it is an active grid of an active, ingested file that isn't in the bin, unless its fingerprint equals the stored one
    (file_id, gid, fingerprint). ``tabs``: file_id, gid, tab_index, sheet_type, active, fingerprint; ``files``: file_id,
    connection, active, trashed, state. A file has few tabs, so the window over a file is small.
    """
    from pyspark.sql import Window

    live = files.where(F.col("active") & ~F.col("trashed") & (F.col("state") == "ingested"))
    if connection is not None:
        live = live.where(F.col("connection") == connection)
    known = fingerprints.select("file_id", "gid", F.col("fingerprint").alias("__known"))
    grids = tabs.where(F.col("active") & (F.col("sheet_type") == "GRID")).join(live.select("file_id"), "file_id", "left_semi")
    due = grids.join(known, ["file_id", "gid"], "left").where(F.col("__known").isNull() | ~F.col("__known").eqNullSafe(F.col("fingerprint")))
    return due.select("file_id", F.row_number().over(Window.partitionBy("file_id").orderBy("tab_index", "gid")).alias("position"), "gid")


def bind_headers(live: DataFrame, contract: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(dataset_id, header, key, status) of live headers (dataset_id, header) and contract columns (dataset_id, header, key, ctype).

    They meet in their folded form. bound: read under the contract; extra: live only, hashed as extra columns; missing: a
    declared column that isn't live and blocks staging; ignored: declared so, live or not.
    """
    l = live.select("dataset_id", F.col("header").alias("l_header"), join_key(F.col("header"), ascii_only).alias("h"))
    c = contract.select("dataset_id", F.col("header").alias("c_header"), "key", "ctype", join_key(F.col("header"), ascii_only).alias("h"))
    both = l.join(c, ["dataset_id", "h"], "full_outer")
    status = (
        F.when(F.col("ctype") == "ignore", F.lit("ignored")).when(F.col("c_header").isNull(), F.lit("extra")).when(F.col("l_header").isNull(), F.lit("missing"))
        .otherwise(F.lit("bound"))
    )
    return both.select("dataset_id", F.coalesce("l_header", "c_header").alias("header"), "key", status.alias("status"))


#: Declarations that one task checks: each takes some 0.1 ms of Python, and hundreds of thousands of keys are one split of a file.
CHECK_ROWS = 10_000


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as ``checked`` needs for them."""
    return scratch.spread(rows, CHECK_ROWS)


@F.pandas_udf(T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("reason", T.StringType()), T.StructField("spec", T.StringType())]))
def checked(declared: pd.Series) -> pd.DataFrame:
    """Of declarations of columns as JSON: whether each is a usable contract, why not, and its spec version. Data never raises."""

    def one(text: str | None) -> tuple:
        try:
            c = build(json.loads(text or ""))
            validate([c])
            return True, None, spec_version([c])
        except (ContractError, TypeError, ValueError, AttributeError) as e:
            return False, str(e) if isinstance(e, ContractError) else type(e).__name__, None

    return pd.DataFrame([one(x) for x in declared], columns=["valid", "reason", "spec"])


def valid_digests(cache: DataFrame, contracts: DataFrame) -> DataFrame:
    """(dataset_id, digest) for each contract (dataset_id, spec_version); null where the cache (dataset_id, spec_version, digest) is of another contract.

    Digests are kept by the contract's version, so a changed contract finds none of the old: nothing has to be dropped.
    """
    return contracts.join(cache, ["dataset_id", "spec_version"], "left").select("dataset_id", "digest")
