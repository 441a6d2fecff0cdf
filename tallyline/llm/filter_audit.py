"""Filter interaction audit: what each filter removes at each place of every order.

1. Every text's failures are found once, whatever removes it, and stored as narrow rows (part, a bit for each failing filter, label flags).
2. Orders form a trie of prefixes. A prefix's survivors don't depend on its order, so a node is an unordered set of
   applied filters. The trie is walked depth first; at a node that no earlier path has met, the next filter is applied
   to its parent's survivors, which are persisted, and one aggregation of the new survivors counts what each of the remaining
   filters removes there: the edges to its children. Nodes met again cost nothing: 32 nodes and 80 edges for 120 orders.
3. The rows of an order are its edges' counts.

Persisted survivors are recomputed from the stored rows if an executor that holds them is lost; at most one a level is
persisted at a time. Counts stay in tables; nothing about parts comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import attach, lean, materialize, remove, scratch_path, slices, small_batches, small_frame, texts_of

FILTERS = "ABCDE"
LEAST_WORDS = 200
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))


def failures(text: str, points: int) -> int:
    """A bit for each of the filters A to D that the text fails; ``points`` is its number of code points."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at ASCII white space
    few = len(words) < LEAST_WORDS
    repeated = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, UPPER))) > 3 * points
    symbols = len(raw) != len(raw.translate(None, SYMBOLS))
    return few | repeated << 1 | loud << 2 | symbols << 3


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails, quality, toxic) of every row, stored; bit i of ``fails`` stands for the filter ``FILTERS[i]``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = texts_of(part, 2)
                points = pc.utf8_length(part.column(2)).fill_null(0).to_pylist()
                fails = pa.array(list(map(failures, texts, points)), pa.int32())
                names = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), fails, names], ["doc_id", "part", "fails", "digest"])

    found = materialize(rows.mapInArrow(lean(run), "doc_id long, part string, fails int, digest binary"), "audit-texts")
    # Copies: partial aggregation before the shuffle, and frequent texts and ids apart on the way back.
    copies = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    copies = materialize(copies, "audit-copies")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("quality"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = known.where("doc_id is not null").join(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "doc_id")
    known = materialize(known, "audit-labels")
    out = attach(found, ["digest"], copies, "copies", F.monotonically_increasing_id())
    out = attach(out, ["doc_id"], known, "rows", F.monotonically_increasing_id())
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    fails = F.col("fails").bitwiseOR(F.shiftleft(copied, 4)).alias("fails")
    out = materialize(out.select("part", fails, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic"))), "audit-rows")
    remove(docs.sparkSession, found, copies, known)
    return out


def _bit(i: int) -> Column:
    return F.col("fails").bitwiseAND(F.lit(1 << i)) != 0


class _Trie:
    """The walk over prefixes; ``path`` collects the counts of each node's edges."""

    def __init__(self, rows: DataFrame, n: int, path: str):
        self.n, self.path, self.met = n, path, set()
        self.walk(rows, 0)

    def walk(self, survivors: DataFrame, applied: int) -> None:
        """Count the edges of a node and go on to its children that no other path has met."""
        self.met.add(applied)
        rest = [i for i in range(self.n) if not applied >> i & 1]
        if not rest:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counts = [F.count_if(c).alias(f"{name}_{i}") for i in rest for name, c in (("removed", _bit(i)), ("good", _bit(i) & F.col("quality")), ("toxic", _bit(i) & F.col("toxic")))]
        at_node = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *counts)
        edges = F.inline(F.array(*(F.struct(F.lit(i).alias("filter"), *(F.col(f"{name}_{i}").alias(name) for name in ("removed", "good", "toxic"))) for i in rest)))
        at_node.select(F.lit(applied).alias("applied"), "part", "n", edges).write.mode("append").parquet(self.path)
        for i in rest:
            if applied | 1 << i not in self.met:
                self.walk(survivors.where(~_bit(i)), applied | 1 << i)
        survivors.unpersist()


def _orders(names: Sequence[str]) -> pa.Table:
    """A row for each order and step, numbered by ``place``: its filter, and the set of those before it."""
    columns: list[list] = [[], [], [], []]
    for order in permutations(range(len(names))):
        applied = 0
        for step, i in enumerate(order, 1):
            for column, value in zip(columns, ("".join(names[j] for j in order), step, i, applied)):
                column.append(value)
            applied |= 1 << i
    return pa.table({"place": pa.array(range(len(columns[0])), pa.int32()), "filter_order": pa.array(columns[0]), **{n: pa.array(c, pa.int32()) for n, c in zip(("step", "filter", "applied"), columns[1:])}})


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part.

    A null text is empty and fails A only (and E, if it repeats one of a smaller id). Null parts are the part ''. Repeated rows count
    as often as they occur; equal ids aren't smaller than each other, a null id has no smaller one and is none.
    ``labels`` may repeat an id (one good or toxic row is enough), and its nulls are neither. Without documents there are no
    parts and no rows. Other columns aren't read, so their names can't clash.
    """
    spark = docs.sparkSession
    rows = judged(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col)
    path = scratch_path(spark, "audit-edges")
    _Trie(rows, len(FILTERS), path)
    edges = spark.read.schema("applied int, part string, n long, filter int, removed long, good long, toxic long").parquet(path)
    totals = [F.count_if(_bit(i)).alias(f"fails_{i}") for i in range(len(FILTERS))] + [F.count_if(F.col("fails") == 1 << i).alias(f"only_{i}") for i in range(len(FILTERS))]
    by_filter = lambda name: F.element_at(F.array(*(F.col(f"{name}_{i}") for i in range(len(FILTERS)))), F.col("filter") + 1)
    parts = materialize(rows.groupBy("part").agg(*totals), "audit-parts")
    orders = _orders(FILTERS)  # the 600 rows that each part has in the result
    grid = parts.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(orders.num_rows - 1)))).join(F.broadcast(small_frame(spark, orders)), "place")
    grid = grid.select("part", "filter_order", "step", "filter", "applied", by_filter("fails").alias("fails"), by_filter("only").alias("unique_fails"))
    out = grid.join(edges, ["part", "applied", "filter"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    shapley = F.sum(zero("removed")).over(Window.partitionBy("part", "filter"))
    return out.select(
        "part", "filter_order", "step", zero(F.col("n") - F.col("removed")).alias("kept"), zero("removed").alias("removed"), zero(F.col("fails") - zero("removed")).alias("redundant"),
        zero("unique_fails").alias("unique_fails"), zero("good").alias("good_lost"), zero("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )
