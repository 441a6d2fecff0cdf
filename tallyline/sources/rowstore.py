"""Tables that survive a run, laid out by bucket: a change rewrites the buckets of its keys only.

``rows/generation=g/bucket=b`` holds the rows of a bucket, ``manifest/version=v`` one row for each bucket: the generation that is
current and what is known about it. Writing ends with the manifest, so a run that is cut off leaves the version before it as it
was, and a repeated run of a version starts from the one before it. ``RowStore`` keeps staged rows with the digest of every bucket: of 256, those of one
edited row are 0.4 % of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline import taxonomy as tx
from tallyline.operators import merkle
from tallyline.sources.scratch import store

COLUMNS = ("key", "canon", "h_row", "state", "quarantine_field", "quarantine_reason")
#: Rows of a bucket that one file takes; a task writes one file.
FILE_ROWS = 1_000_000
#: Manifests that stay, for readers that hold an older one and for repeated runs.
KEPT = 2


def dataset_path(base: str, uid: str, spec: str, side: str) -> str:
    """Rows of another contract are another dataset: a new spec version starts without stored digests."""
    return f"{base.rstrip('/')}/{hashlib.sha256(uid.encode()).hexdigest()[:32]}/{spec[:32]}/{side}"


class BucketTable:
    """Rows with a ``bucket`` column. One writer at a time; readers see whole versions."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema
        #: Rows that the last change read and wrote.
        self.rows_read = self.rows_written = 0

    def _manifests(self) -> DataFrame | None:
        """All manifests that are kept. Each has a row of bucket -1, so that one without rows is a version, too."""
        try:
            return self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException:
            return None

    def manifest(self, before: int | None = None) -> DataFrame | None:
        """(version, bucket, generation, n, ...) of the buckets that have rows, of the last version (before one); None if there is none."""
        every = self._manifests()
        if every is None:
            return None
        every = every if before is None else every.where(F.col("version") < before)
        last = every.agg(F.max("version")).first()[0]
        return None if last is None else every.where((F.col("version") == last) & (F.col("bucket") >= 0))

    def version(self) -> int:
        every = self._manifests()
        return 0 if every is None else every.agg(F.max("version")).first()[0]

    def describe(self, rows: DataFrame) -> DataFrame:
        """What the manifest says of each bucket of stored rows: (bucket, n, ...)."""
        return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))

    def _write(self, rows: DataFrame, generation: int) -> DataFrame:
        """Write buckets as a generation; their part of the manifest."""
        rows = store(rows, "rows")
        n = rows.count()
        buckets = rows.select("bucket").distinct().count()
        files = n // (max(1, buckets) * FILE_ROWS) + 1
        parts = rows.repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(files)))
        parts.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/generation={generation}")
        self.rows_written = n
        about = self.describe(rows)
        return about.select("bucket", F.lit(generation).alias("generation"), *(c for c in about.columns if c != "bucket"))

    def _commit(self, manifest: DataFrame, version: int) -> None:
        """Make a version current; manifests before the last ``KEPT`` go, and the rows of buckets that no manifest names any more."""
        mark = self.spark.range(1).select(F.lit(-1).alias("bucket"), F.lit(version).alias("generation"), F.lit(0).cast("bigint").alias("n"))
        rows = manifest.unionByName(mark, allowMissingColumns=True)  # a row a bucket
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        named = self.spark.read.parquet(f"{self.path}/manifest").select("version", "generation", "bucket").collect()
        last = sorted({r["version"] for r in named})[-KEPT:]
        for old in {r["version"] for r in named} - set(last):
            self._delete(f"{self.path}/manifest/version={old}")
        kept = {(r["generation"], r["bucket"]) for r in named if r["version"] in last}
        live = {g for g, _ in kept}
        for g, folder in self._folders(f"{self.path}/rows"):
            if g not in live:
                self._delete(folder)
                continue
            for b, part in self._folders(folder):
                if (g, b) not in kept:
                    self._delete(part)

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        found, fs = self._path(path)
        fs.delete(found, True)

    def _folders(self, path: str) -> list[tuple[int, str]]:
        """(number, path) of folders named ``<what>=<number>``."""
        root, fs = self._path(path)
        names = [str(s.getPath()) for s in fs.listStatus(root)] if fs.exists(root) else []
        return [(int(n.rpartition("=")[2]), n) for n in names if "=" in n.rpartition("/")[2]]

    def replace(self, rows: DataFrame, version: int | None = None) -> None:
        """All rows anew."""
        version = self.version() + 1 if version is None else version
        self.rows_read = 0
        self._commit(self._write(rows, version), version)

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> list[int]:
        """Rewrite the buckets of ``changes`` (stored, with ``bucket``) as ``combine(stored rows, changes)``; returns these buckets.

        Of other buckets nothing is read. With a ``version`` the change is applied to the version before it: repeating it changes nothing.
        """
        old = self.manifest(version)
        version = self.version() + 1 if version is None else version
        touched = sorted(r["bucket"] for r in changes.select("bucket").distinct().collect())
        if old is None:
            self.replace(combine(self.rows([]), changes), version)
            return touched
        mine = F.col("bucket").isin(touched)
        self.rows_read = old.where(mine).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rest = old.where(~mine).drop("version")
        if touched:
            new = self._write(combine(self.rows(touched, old), changes), version)
            rest = rest.select(*new.columns).unionByName(new)
        self._commit(store(rest, "manifest"), version)
        return touched

    def rows(self, buckets: list[int] | None = None, manifest: DataFrame | None = None) -> DataFrame:
        """The rows of some buckets (of all): nothing else is read."""
        m = self.manifest() if manifest is None else manifest
        found = [] if m is None or buckets == [] else m.select("bucket", "generation").collect()
        paths = [f"{self.path}/rows/generation={r['generation']}/bucket={r['bucket']}" for r in found if buckets is None or r["bucket"] in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        # ``generation`` is a partition column, too.
        return self.spark.read.schema(f"{self.schema}, bucket int, generation int").option("basePath", f"{self.path}/rows").parquet(*paths).drop("generation")

    def count(self) -> int:
        m = self.manifest()
        return 0 if m is None else m.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class RowStore(BucketTable):
    """Staged rows of one side of a dataset under one contract, with the digest of every bucket."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "key", "key binary, canon map<string,string>, h_row string, state string, quarantine_field string, quarantine_reason string")

    def describe(self, rows: DataFrame) -> DataFrame:
        unreadable = rows.groupBy("bucket").agg(F.count_if(F.col("state") == "quarantined").alias("unreadable"))
        digests = merkle.bucket_digests(merkle.entries(rows, F.col("key"), F.col("h_row"), F.col("state") == "quarantined"))
        return digests.join(unreadable, "bucket").select("bucket", "n", "unreadable", "digest")

    def replace(self, rows: DataFrame, version: int | None = None) -> None:
        """All rows anew (staged rows: ``bucket`` and ``COLUMNS``)."""
        super().replace(rows.select("bucket", *COLUMNS), version)

    def apply(self, changes: DataFrame) -> list[int]:
        """Put and drop rows by key; returns the buckets that were digested anew.

        ``changes`` are staged rows with a boolean ``gone``. A key's stored rows go; its rows that aren't ``gone`` take their place.
        """
        if self.manifest() is None:
            raise ValueError("apply() needs stored rows: call replace() first")

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            kept = old.join(new.select("key").distinct(), "key", "left_anti").select("bucket", *COLUMNS)
            return kept.unionByName(new.where(~F.col("gone")).select("bucket", *COLUMNS))

        return self.merge(store(changes.select("bucket", *COLUMNS, "gone"), "changes"), combine)

    def digests(self) -> DataFrame:
        """(bucket, n, digest) of all 256 buckets, as stored."""
        m = self.manifest()
        empty = self.spark.createDataFrame([], "bucket int, n bigint, digest string")
        return merkle.all_buckets(empty if m is None else m.select("bucket", "n", "digest"))

    def unreadable_buckets(self) -> list[int]:
        m = self.manifest()
        return [] if m is None else [r["bucket"] for r in m.where("unreadable > 0").select("bucket").collect()]
