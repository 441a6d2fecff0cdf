"""Exact deduplication by deterministic block naming.

Normalised texts are cut into blocks of a fixed size. Equal blocks get equal integer names, different blocks different
ones, by sorting: rows are dealt to partitions by their block, sorted, and numbered in runs of equal content. Then
adjacent names are paired and the pairs named in the same way, level by level, until each document has one name.
Names stand for content by comparison, never by digest, so the identity is free of collisions.

Blocks and pairs that hold more than 1/``HOT`` of all rows of their level, so fewer than ``HOT`` of them, each of a
block's size at most, are named on the driver and reach their rows by a broadcast: a large group of copies never meets
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import attach, fresh, lean, materialize, remove, small_batches, small_frame

BLOCK_BYTES = 4096
HOT = 500
_WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, " ")


def _name(rows: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` (rid, pos, last, key) with the integer ``name`` of each key in place of the key.

    Every key gets one name: negative for the hot ones, else the task's number and a count of its sorted runs.
    """
    out = None
    if hot is not None:
        rows = rows.join(F.broadcast(hot), rows[key] == hot["h_key"], "left")
        out = rows.where(F.col("h_name").isNotNull()).select("rid", "pos", "last", F.col("h_name").alias("name"))
        rows = rows.where(F.col("h_name").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, before = (TaskContext.get().partitionId() << 33) - 1, None
        for batch in batches:
            names = []
            for k in batch.column(3).to_pylist():
                if k != before:
                    name, before = name + 1, k
                names.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.int64())], ["rid", "pos", "last", "name"])

    dealt = rows.select("rid", "pos", "last", key).repartition(key).sortWithinPartitions(key)
    cold = dealt.mapInArrow(lean(run), "rid long, pos int, last int, name long")
    return cold if out is None else out.unionByName(cold)


def _hot(rows: DataFrame, key: str, total: int) -> DataFrame | None:
    """Keys of more than total/HOT of the ``total`` rows, named in their order; found by a count of 8-byte hashes, confirmed by content."""
    least = total // HOT + 1
    h = F.xxhash64(key)
    hashes = [r[0] for r in rows.groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("h").collect()]
    if not hashes:
        return None
    found = rows.where(h.isin(hashes)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select(key).collect()
    keys = sorted(bytes(r[0]) for r in found)
    if not keys:
        return None
    return small_frame(rows.sparkSession, pa.table({"h_key": pa.array(keys, pa.binary()), "h_name": pa.array(range(-1, -1 - len(keys), -1), pa.int64())}))


def identities(docs: DataFrame, *, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (with a unique long ``rid``) as (rid, identity): equal numbers for equal normalised texts, and only for those."""
    small_batches(docs.sparkSession)
    data = normalised(F.col(text_col)).cast("binary")
    size = F.octet_length("data")
    base = docs.select("rid", data.alias("data")).withColumn("last", F.floor((F.greatest(size, F.lit(1)) - 1) / block_bytes).cast("int"))
    blocks = base.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("last"))))
    blocks = blocks.select("rid", "pos", "last", F.call_function("substring", F.col("data"), F.col("pos") * block_bytes + 1, F.lit(block_bytes)).alias("key"))
    # A document's number of blocks is part of its last name, so equal names need equal lengths in blocks.
    total = base.agg(F.sum(F.col("last") + 1)).first()[0] or 0
    named = materialize(_name(blocks, "key", _hot(blocks, "key", total)), "block-names")
    done, level = [], 0
    while True:
        done.append(named.where(F.col("last") == 0).select("rid", F.lit(level).alias("level"), "name"))
        rest = named.where(F.col("last") > 0)
        total = rest.where(F.col("pos") == 0).agg(F.sum(F.floor(F.col("last") / 2) + 1)).first()[0] or 0
        if not total:
            break
        pair = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"].cast("string")), ",")
        pairs = rest.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos"), F.floor(F.col("last") / 2).cast("int").alias("last")).agg(pair.cast("binary").alias("key"))
        pairs = materialize(pairs, "block-pairs")
        named = materialize(_name(pairs, "key", _hot(pairs, "key", total)), "block-names")
        remove(docs.sparkSession, pairs)
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("rid", F.struct("level", "name").alias("identity"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Of equal texts the row with the smallest id stays (null ids last; of equal ids the first row read). ``rid`` numbers
    the rows as they are scanned, once: the numbered rows are stored. Null and empty texts are equal; repeated rows form
    a group; an empty table gives an empty one; other columns are not read.
    """
    return _dedup(materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "numbered"))


def _dedup(rows: DataFrame) -> DataFrame:
    """``dedup`` of a stored table (rid, doc_id, text)."""
    names = identities(rows)
    keys = materialize(rows.select("rid", "doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256")).join(names, "rid"), "identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    groups = keys.groupBy("identity").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > 1)
    groups = materialize(groups, "groups")
    out = attach(keys, ["identity"], groups, "group_size", F.col("rid"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("rid"))
    first = F.coalesce("first", own)
    return out.select(
        "rid",
        "doc_id",
        first["doc_id"].alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (first["rid"] == F.col("rid")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``dedup`` doesn't keep; columns as they were.

    Of null and empty texts one row stays, of repeated rows one; an empty table gives an empty one.
    """
    rid = fresh(docs.columns, "rid")
    numbered = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(rid).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = _dedup(rows).where(~F.col("kept")).select(F.col("rid").alias("gone"))
    return numbered.join(gone, numbered[rid] == gone["gone"], "left_anti").drop(rid)
