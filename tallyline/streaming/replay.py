"""Change streams: latest-state replay, absence counters, change-triggered alerts.

The checkpoint is the cursor: a batch's data are committed before its offset, so a restart repeats a batch at most, and
every step is idempotent. State tables are versioned by bucket (``sources.rowstore``), a version for each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyline.sources.cursors import MetaStore
from tallyline.sources.listings import replay
from tallyline.sources.rowstore import BucketTable
from tallyline.sources.scratch import store


def latest(events: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, columns): the last event of each key by ``order``; one row a key and task is shuffled."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("s")).select(key, *(F.col(f"s.{c}").alias(c) for c in columns))


#: Buckets of a replayed state: the part of it that one changed id rewrites.
STATE_BUCKETS = 1024


class ReplaySink:
    """``foreachBatch`` target that keeps the latest state of each id under ``path``, by buckets of its hash.

    A batch reads and rewrites the buckets of its ids only, as the version of its epoch. A repeated batch starts from the version before its own.
    """

    def __init__(self, path: str, columns: Sequence[str], seed: DataFrame | None = None, buckets: int = STATE_BUCKETS):
        self.path, self.columns, self.seed, self.buckets = path, list(columns), seed, buckets
        #: Rows that the last batch read and wrote.
        self.rows_read = self.rows_written = 0

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _table(self, spark: SparkSession, schema: str) -> BucketTable:
        return BucketTable(spark, self.path, "id", schema)

    def versions(self, spark: SparkSession) -> list[int]:
        m = self._table(spark, "id string").manifest()
        return [] if m is None else sorted(r[0] for r in spark.read.parquet(f"{self.path}/manifest").select("version").distinct().collect())

    def read(self, spark: SparkSession, schema: str | None = None) -> DataFrame | None:
        """The state (id, columns); ``schema`` spares the inference from files."""
        table = self._table(spark, schema or "")
        m = table.manifest()
        if m is None:
            return self.seed
        if schema is None:
            table.schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{self.path}/rows").schema if f.name not in ("bucket", "generation"))
        return table.rows().drop("bucket")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        from tallyline.sources.listings import latest_changes

        spark = batch.sparkSession
        changes = latest_changes(batch)
        plain = changes.select("id", *(F.col(f"file.{c}").alias(c) for c in self.columns))
        table = self._table(spark, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema))
        if self.seed is not None and table.manifest(epoch) is None:
            table.replace(self.seed.select("id", *self.columns, self._bucket()), -1)
        changes = store(changes.withColumn("bucket", self._bucket()), "changes")
        table.merge(changes, lambda old, new: replay(old, new, self.columns).withColumn("bucket", self._bucket()), epoch)
        self.rows_read, self.rows_written = table.rows_read, table.rows_written


def start_replay(changes: DataFrame, sink: ReplaySink, checkpoint: str, **trigger) -> StreamingQuery:
    """Run a stream of change records into ``sink``; ``availableNow=True`` by default."""
    return changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def needs_full_scan(cursor: str | None, valid: bool, age_seconds: float | None, full_interval: float) -> bool:
    """Without a valid cursor, or when the last full scan is too old, enumerate anew; mint the next cursor before the scan."""
    return not cursor or not valid or age_seconds is None or age_seconds > full_interval


def full_scan_due(cursor: Column, valid: Column, age_seconds: Column, full_interval: float) -> Column:
    """``needs_full_scan`` of many subjects."""
    return F.coalesce(cursor == "", F.lit(True)) | ~F.coalesce(valid, F.lit(False)) | age_seconds.isNull() | (age_seconds > full_interval)


def wait_seconds(failures: Column, interval: float, first: float = 5.0) -> Column:
    """``backoff`` of many subjects."""
    return F.when(failures <= 0, F.lit(interval)).otherwise(F.least(F.lit(interval), F.lit(first) * F.pow(F.lit(2.0), failures - 1)))


def absence(scans: DataFrame, seen: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, missing_run_count, missing_since) after ordered scans (scan, at, complete) with sightings (scan, key).

    Counts the complete scans since the last sighting; incomplete scans neither count nor reset. How many complete scans
    follow each scan, and when the next one was, is worked out once over the list of scans (a row each, so one window over
    them is small); keys join it by their last sighting.
    """
    from pyspark.sql import Window

    last = seen.groupBy("key").agg(F.max("scan").alias("last"))
    base = keys.select("key").distinct().join(last, "key", "left")
    known = scans.where("complete").select("scan", "at", F.lit(1).alias("counts"))
    points = known.unionByName(seen.select("scan").distinct().select("scan", F.lit(None).cast(dict(scans.dtypes)["at"]).alias("at"), F.lit(0).alias("counts")))
    points = points.unionByName(known.limit(0).unionByName(scans.sparkSession.range(1).select(F.lit(None).cast(dict(scans.dtypes)["scan"]).alias("scan"), F.lit(None).cast(dict(scans.dtypes)["at"]).alias("at"), F.lit(0).alias("counts"))))
    one = points.groupBy("scan").agg(F.sum("counts").alias("counts"), F.min("at").alias("at"))
    after = Window.orderBy("scan").rowsBetween(1, Window.unboundedFollowing)  # the null scan comes first: before all
    lookup = one.select(F.col("scan").alias("__scan"), F.coalesce(F.sum("counts").over(after), F.lit(0)).cast("bigint").alias("missing_run_count"), F.first("at", ignorenulls=True).over(after).alias("missing_since"))
    return base.join(lookup, F.col("last").eqNullSafe(F.col("__scan"))).select("key", "missing_run_count", "missing_since")


def absence_function() -> Callable:
    """A function for ``applyInPandasWithState`` that counts complete scans without a sighting: input (key, scan, seen, complete)."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, since = state.get if state.exists else (0, None)
        for frame in frames:
            for scan, seen, complete in frame.sort_values("scan")[["scan", "seen", "complete"]].itertuples(index=False):
                if seen:
                    n, since = 0, None
                elif complete:
                    n, since = n + 1, int(scan) if since is None else since
        state.update((n, since))
        yield pd.DataFrame({"key": [key[0]], "missing_run_count": [n], "missing_since_scan": pd.array([since], dtype="Int64")})

    return count


def absence_stream(sightings: DataFrame) -> DataFrame:
    """Streaming absence counters of (key, scan, seen, complete)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return sightings.groupBy("key").applyInPandasWithState(
        absence_function(), "key string, missing_run_count long, missing_since_scan long", "n long, since long", "update", GroupStateTimeout.NoTimeout
    )


ABSENCE_SCHEMA = "key string, missing_run_count long, missing_since long, due boolean"


class AbsenceTimer(StatefulProcessor):
    """Of each key how many complete scans in a row missed it, since when, and whether both limits are reached: ``runs`` scans and ``milliseconds``.

    Value state holds the count and the time of the first missing scan; a processing-time timer is set for when the time is up. A row goes out at every
    scan of the key (``due`` if both hold by then) and when the timer fires with the runs reached: whichever comes last makes a key due. A
    sighting deletes the timer and starts anew.
    """

    def __init__(self, runs: int, milliseconds: int):
        self.runs, self.milliseconds = runs, milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("absence", "n long, since long")

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _row(self, key: tuple, n: int, since: int | None, now: int) -> pd.DataFrame:
        due = since is not None and n >= self.runs and now - since >= self.milliseconds
        return pd.DataFrame({"key": [key[0]], "missing_run_count": [n], "missing_since": pd.array([since], dtype="Int64"), "due": [due]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        n, since = self.state.get() if self.state.exists() else (0, None)
        frame = pd.concat(list(rows), ignore_index=True).sort_values("scan")  # a key's scans in one batch: few
        for seen, complete in frame[["seen", "complete"]].itertuples(index=False):
            if seen:
                n, since = 0, None
                self._forget_timers()
            elif complete:
                n += 1
                if since is None:
                    since = now
                    self.handle.registerTimer(now + self.milliseconds)
        self.state.update((n, since))
        yield self._row(key, n, since, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, since = self.state.get()
        if since is not None and n >= self.runs:
            yield self._row(key, n, since, max(timerValues.getCurrentProcessingTimeInMs(), since + self.milliseconds))

    def close(self) -> None:
        pass


def absence_timers(sightings: DataFrame, runs: int, milliseconds: int) -> DataFrame:
    """Streaming absence of (key, scan, seen, complete) with both limits (``AbsenceTimer``). Needs the RocksDB state store."""
    return sightings.groupBy("key").transformWithStateInPandas(AbsenceTimer(runs, milliseconds), ABSENCE_SCHEMA, "Update", "ProcessingTime")


class AlertOnChange:
    """``foreachBatch`` target that calls ``send`` only when the findings' fingerprint differs from the last one sent.

    With a ``memory`` (``sources.cursors.MetaStore``) the last fingerprint outlives a restart; it is written after sending.
    """

    def __init__(self, columns: Sequence[str], send: Callable[[str, int], None], last: str = "", memory: MetaStore | None = None, name: str = "alert"):
        self.columns, self.send, self.memory, self.name = list(columns), send, memory, name
        self.last = (memory.get(name) if memory else None) or last

    def __call__(self, found: DataFrame, epoch: int) -> None:
        from tallyline.operators.reporting import fingerprint

        now = fingerprint(found, self.columns).first()["fingerprint"]
        if now != self.last:
            self.send(now, found.count())
            self.last = now
            if self.memory:
                self.memory.put(self.name, now)


def backoff(failures: int, interval: float, first: float = 5.0) -> float:
    """Seconds to wait after failures in a row, doubling, never over the polling interval."""
    return interval if failures <= 0 else min(interval, first * 2 ** (failures - 1))
