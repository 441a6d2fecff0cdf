"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: UTF-8 bytes of text that a Python worker handles at once (a single larger text goes alone).
SLICE_BYTES = 1 << 20


_resident: dict[Hashable, Any] = {}


def trim() -> None:
    """Give freed memory back to the system: Python's arenas, Arrow's pool, the C heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def resident(key: Hashable, make: Callable[[], Any]) -> Any:
    """The large table that a Python worker keeps between tasks: one at a time.

    Workers outlive stages. A stage that asks for another table drops the one before it, so memory doesn't add up
    over the stages of a session; the tasks of one stage share theirs.
    """
    if key not in _resident:
        _resident.clear()
        trim()
        _resident[key] = make()
    return _resident[key]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which leaves no memory behind when a task ends (with ``keeps``, its resident table alone)."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _resident.clear()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent on one machine (tests), a temporary folder is made and set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallyline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """For this session: Arrow batches of at most 2 MB, and whole texts read 1,024 rows at a time. A worker and its JVM hold several of each."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1024")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tallyline/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def remove(spark: SparkSession, *frames_or_paths: DataFrame | str) -> None:
    """Delete scratch tables (paths, or the very frames that ``materialize`` returned) once nothing reads them again."""
    jvm = spark._jvm
    for x in frames_or_paths:
        path = jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, between the many jobs of one operator.

    It does so when the driver's garbage is collected; a job's plan goes in the first round, its shuffles in the second.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def small_frame(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A frame of a few rows that the driver holds; as Arrow, which starts no Python workers of another kind."""
    return spark.createDataFrame(table)


def fresh(names: list[str], base: str) -> str:
    """``base``, lengthened until it clashes with none of ``names`` (Spark compares names without case)."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base


def plus(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``limit`` bytes of the column (or a single row)."""
    if batch.num_rows == 0:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def bounded_sample(df: DataFrame, key: Column, bound: int, strata: Column | None = None, more: Column | None = None) -> Column:
    """A predicate that keeps at most ``bound`` rows (of each stratum), chosen by a hash of ``key``, an id.

    The choice depends on the rows alone, not on partitions. Rows of equal keys go in or out together. A key of more than ``bound``
    rows never fits: the sample is filled from the others, from as much of the hash space as that takes. Where these
    are too few (ids that are mostly null or the same), ``more``, say the text, tells rows apart. Rows are counted by hash before
    anything comes to the driver: at most ``bound + 1`` hashes of each large stratum at a time.
    """
    spread = 1 << 40
    h = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(spread))
    s = (strata if strata is not None else F.lit("")).cast("string")
    counts = {r["s"]: r["n"] for r in df.groupBy(s.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for k, n in counts.items():
        mine = s.eqNullSafe(F.lit(k))
        if n <= bound:
            keep = keep | mine
            continue
        share = min(1.0, 1.5 * bound / n)
        while True:
            here = df.where(mine & (h < F.lit(int(share * spread)))).groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n"))
            total, cut, out = 0, 0, []
            for r in here.where(F.col("n") <= bound).orderBy("h").limit(bound + 1).collect():
                if total + r["n"] <= bound:
                    total, cut = total + r["n"], r["h"] + 1
                else:
                    out.append(r["h"])
            if out or total == bound or share == 1:
                break
            share = min(1.0, share * 8)
        if not out and total < bound and more is not None:
            keep = keep | (mine & bounded_sample(df.where(mine), F.xxhash64(key, more), bound))
            continue
        # Keys of more than ``bound`` rows under the cut: a few, as the rows there are a few bounds or such keys.
        out = [x for x in out if x < cut] + [r["h"] for r in here.where((F.col("n") > bound) & (F.col("h") < cut)).select("h").collect()]
        keep = keep | (mine & (h < F.lit(cut)) & (~h.isin(out) if out else F.lit(True)))
    return keep


def attach(left: DataFrame, on: list[str], right: DataFrame, count: str, spread: Column, hot: int = 500) -> DataFrame:
    """``left`` with the columns of ``right`` (null where none fits), a left join that a hot key doesn't slow.

    ``right`` is a stored table with one row for each key; ``count`` says how many rows of ``left`` have it. Keys
    of more than 1/hot of the summed counts, at most ``hot`` of them, are broadcast; their rows get a salt
    from ``spread``, so that they spread over the partitions of the shuffle join for all others.
    """
    extras = [c for c in right.columns if c not in on]
    total = right.agg(F.sum(count)).first()[0] or 0
    hots = right.where(F.col(count) > total / hot).select(*(F.col(c).alias(f"_h_{c}") for c in right.columns))
    colds = right.where(F.col(count) <= total / hot).select(*(F.col(c).alias(f"_c_{c}") for c in right.columns), F.lit(0).cast("long").alias("_c_salt"))

    def same(side: str) -> Column:
        out = F.lit(True)
        for c in on:
            out = out & (F.col(c) == F.col(f"_{side}_{c}"))
        return out

    if clash := {c for c in left.columns if c.startswith(("_h_", "_c_", "_salt"))}:
        raise ValueError(f"reserved names: {sorted(clash)}")
    out = left.join(F.broadcast(hots), same("h"), "left")
    out = out.withColumn("_salt", F.when(F.col(f"_h_{on[0]}").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long")))
    out = out.join(colds, same("c") & (F.col("_salt") == F.col("_c_salt")), "left")
    return out.select(*left.columns, *(F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in extras))
