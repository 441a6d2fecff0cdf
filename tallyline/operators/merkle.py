"""Bucketed Merkle digests of keyed rows.

Rows are reduced to (bucket, key, hash) and stored before the only shuffle, which goes by bucket. A digest is of its bucket's
rows in key order, so the rows of a bucket are sorted in one task (with spilling) and stream through a running SHA-256:
time is linear in the rows and nothing but a batch is in memory, whatever the size of the dataset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import taxonomy as tx
from tallyline.functions.hashing import bucket_of, lit, quarantine_hash, sha, varint
from tallyline.ship import ship
from tallyline.sources.scratch import store


def entries(df: DataFrame, key: Column, row_hash: Column, quarantined: Column | None = None) -> DataFrame:
    """(bucket, key, h) of each row; an unreadable row has its sentinel, so that it still counts."""
    h = row_hash if quarantined is None else F.when(quarantined, quarantine_hash(key)).otherwise(row_hash)
    return df.select(bucket_of(key).alias("bucket"), key.alias("key"), h.alias("h"))


def sequence_digests(df: DataFrame, group: str, order: Sequence[str], head: Column, body: Column, keep: Sequence[str] = ()) -> DataFrame:
    """(group, keep..., digest): the SHA-256 (hex) of ``head`` and then of every row's ``body`` in order, for each group.

    ``head`` and the columns to keep are the same in all rows of a group. Neither may be null.
    """
    ship(df.sparkSession)
    rows = df.withColumn("__head", head).withColumn("__body", body).repartition(group).sortWithinPartitions(group, *order)
    rows = rows.select(group, *keep, "__head", "__body")
    out = rows.select(group, *keep).schema.add("digest", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sha = None

        fields: list[pa.Field] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            wanted = [*fields, pa.field("digest", pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), wanted)], [f.name for f in wanted])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            fields = list(batch.schema)[:-2]
            columns = [c.to_pylist() for c in batch.columns]
            groups, bodies, found = columns[0], columns[-1], []
            i = 0
            while i < len(groups):
                j = i + 1
                while j < len(groups) and groups[j] == groups[i]:
                    j += 1
                if at is None or at[0] != groups[i]:
                    if at is not None:
                        found.append((*at, sha.hexdigest()))
                    at, sha = tuple(c[i] for c in columns[:-2]), hashlib.sha256(columns[-2][i])
                sha.update(b"".join(bodies[i:j]))
                i = j
            if found:
                yield done(found)
        if at is not None:
            yield done([(*at, sha.hexdigest())])

    return rows.mapInArrow(run, out)


def bucket_digests(rows: DataFrame) -> DataFrame:
    """(bucket, n, digest) of the buckets that have rows."""
    rows = store(rows.select("bucket", "key", "h"), "entries")
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # at most 256 rows
    head = F.concat(lit(tx.BUCKET_PREFIX), varint(F.col("bucket")), varint(F.col("n")))
    body = F.concat(varint(F.octet_length("key")), F.col("key"), F.unhex("h"))
    found = sequence_digests(rows.join(F.broadcast(counts), "bucket"), "bucket", ("key", "h"), head, body, keep=("n",))
    return found.select("bucket", "n", F.substring("digest", 1, 32).alias("digest"))


def bucket_digest(bucket: str, n: str, body: str) -> Column:
    return sha(F.concat(lit(tx.BUCKET_PREFIX), varint(F.col(bucket)), varint(F.col(n)), F.col(body)), 32)


def all_buckets(digests: DataFrame) -> DataFrame:
    """The digests of all 256 buckets, empty ones included."""
    spark = digests.sparkSession
    every = spark.range(tx.BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    out = every.join(digests, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")).withColumn("body", lit(b""))
    return out.select("bucket", "n", F.coalesce("digest", bucket_digest("bucket", "n", "body")).alias("digest"))


def dataset_digest(every: DataFrame, spec: str, uid: str) -> DataFrame:
    """One row (n, digest) over the 256 bucket digests in order."""
    listed = F.array_sort(F.collect_list(F.struct("bucket", "digest")))
    joined = every.agg(F.sum("n").alias("n"), F.unhex(F.array_join(F.transform(listed, lambda x: x["digest"]), "")).alias("body"))
    head = lit(tx.DATASET_PREFIX + spec.encode() + b"\0" + uid.encode() + b"\0")
    return joined.select("n", F.sha2(F.concat(head, varint(F.col("n")), F.col("body")), 256).alias("digest"))


def diff_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """The buckets in which two sets of all bucket digests differ."""
    return a.alias("a").join(b.alias("b"), "bucket", "full_outer").where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select("bucket")


def rows_in_buckets(df: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows whose ``bucket`` differs; at most 256 numbers are broadcast."""
    return df.join(F.broadcast(buckets.select("bucket").distinct()), "bucket", "left_semi")
