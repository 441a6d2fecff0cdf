"""Cursors and other small facts that outlive a run, and the paged change feed that moves a cursor.

A fact is written only after the data that it stands for. The store is append-only: a value is one row, the newest row of a
name counts, so a reader never sees half of a change and a lost driver loses nothing that was put.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.sources.listings import CHANGE_SCHEMA, MAX_CHANGE_PAGES, Read

FACT_SCHEMA = "name string, value string, seq bigint, writer string"
#: Files of facts from which on a writer puts the newest facts into one.
COMPACT_FILES = 64
CHANGE_PAGE_SCHEMA = f"subject string, page int, pageToken string, nextPageToken string, newStartPageToken string, changes array<struct<{CHANGE_SCHEMA}>>"


def newest(facts: DataFrame) -> DataFrame:
    """(name, value) of the facts (name, value, seq, writer): the newest of each name, of equal ones that of the last writer by name; a null value forgets the name."""
    return facts.groupBy("name").agg(F.max_by("value", F.struct("seq", "writer")).alias("value")).where(F.col("value").isNotNull())


class MetaStore:
    """Facts under ``path`` (a folder that all machines share). A batch of facts is one file; many files become one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.writer = spark, path, uuid.uuid4().hex

    def _files(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [str(s.getPath()) for s in fs.listStatus(root) if s.getPath().getName().endswith(".parquet")] if fs.exists(root) else []

    def facts(self) -> DataFrame:
        return self.spark.read.schema(FACT_SCHEMA).parquet(self.path) if self._files() else self.spark.createDataFrame([], FACT_SCHEMA)

    def get(self, name: str) -> str | None:
        row = newest(self.facts().where(F.col("name") == name)).first()
        return row["value"] if row else None

    def put(self, name: str, value: str | None) -> None:
        self.put_all(self.spark.createDataFrame([(name, value)], "name string, value string"))

    def put_all(self, facts: DataFrame) -> None:
        """Write facts (name, value) as one file, newer than all that this store has."""
        files = self._files()
        last = self.facts().agg(F.max("seq")).first()[0] or 0
        seq = F.lit(max(last + 1, time.time_ns())).cast("bigint").alias("seq")
        facts.select("name", "value", seq, F.lit(self.writer).alias("writer")).coalesce(1).write.mode("append").parquet(self.path)
        if len(files) >= COMPACT_FILES:
            self.compact(files)

    def compact(self, files: list[str]) -> None:
        """The newest facts of some files as one; facts keep their ``seq``, so a reader may see both."""
        old = self.spark.read.schema(FACT_SCHEMA).parquet(*files)
        kept = old.groupBy("name").agg(F.max_by(F.struct("value", "seq", "writer"), F.struct("seq", "writer")).alias("f")).select("name", "f.*")
        kept.coalesce(1).write.mode("append").parquet(self.path)
        for f in files:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)


def feed_state(pages: DataFrame, max_pages: int = MAX_CHANGE_PAGES) -> DataFrame:
    """(subject, pages, complete, reason, cursor) of the pages of change feeds (CHANGE_PAGE_SCHEMA), a row for each subject.

    A feed is complete if its last page, and only that, has no next token and carries the new start token, no next token
    repeats (nor is the one it began with), no page is missing, and it is not longer than ``max_pages`` with more to come. Only a
    complete feed gives a cursor; an empty last page does too. A start token on an earlier page is not trusted.
    """
    of = lambda what, page: F.max_by(what, page)
    found = pages.groupBy("subject").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("nextPageToken").isNotNull()).alias("following"), F.max("page").alias("last"), F.min("page").alias("first"),
        F.count_distinct(F.when(F.col("nextPageToken").isNotNull(), F.col("nextPageToken"))).alias("tokens"), F.min_by("pageToken", "page").alias("begun"),
        F.array_agg("nextPageToken").alias("nexts"), of("nextPageToken", "page").alias("pending"), of("newStartPageToken", "page").alias("start"),
    )
    reason = (
        F.when((F.col("tokens") != F.col("following")) | F.array_contains("nexts", F.col("begun")), F.lit("repeated_token"))
        .when((F.col("last") - F.col("first") + 1 != F.col("pages")) | (F.col("following") < F.col("pages") - 1), F.lit("missing_page"))
        .when(F.col("pending").isNotNull() & (F.col("pages") >= max_pages), F.lit("too_many_pages"))
        .when(F.col("pending").isNotNull(), F.lit("unfinished"))
        .when(F.col("start").isNull(), F.lit("no_new_token"))
    )
    out = found.withColumn("reason", reason)
    return out.select("subject", "pages", F.col("reason").isNull().alias("complete"), "reason", F.when(F.col("reason").isNull(), F.col("start")).alias("cursor"))


def read_feed(pages: DataFrame, max_pages: int = MAX_CHANGE_PAGES) -> tuple[Read, DataFrame]:
    """All changes of the pages (subject, change fields), whether every feed is complete, and the feeds' states."""
    state = feed_state(pages, max_pages)
    reasons = tuple(sorted(r[0] for r in state.where(~F.col("complete")).select("reason").distinct().collect()))
    rows = pages.select("subject", F.explode("changes").alias("c")).select("subject", "c.*")
    return Read(rows, not reasons, reasons), state


def advance(store: MetaStore, state: DataFrame, subjects: Sequence[str]) -> dict[str, str]:
    """Write the new cursors of complete feeds among ``subjects``; call it after their changes are stored."""
    done = state.where(F.col("complete") & F.col("subject").isin(list(subjects)))
    rows = done.select("subject", "cursor").collect()
    if rows:
        facts = [(f"cursor:{r['subject']}", r["cursor"]) for r in rows]
        store.put_all(store.spark.createDataFrame(facts, "name string, value string"))
    return {r["subject"]: r["cursor"] for r in rows}


def cursor(store: MetaStore, subject: str) -> str | None:
    """The stored cursor; none means: mint a new one first, then enumerate everything."""
    return store.get(f"cursor:{subject}")
