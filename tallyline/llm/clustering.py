"""Centroid clustering in exact integers, with Hamerly's bounds.

Every vector becomes integers ``floor(scale * x)``; centroids, distances and sums are integers, so the result doesn't
depend on how rows are dealt. Beside its vector each row keeps its cluster, one upper bound of the distance to its own
centroid and one lower bound of the distance to every other: persisted state, written each round. When centroids move, the upper
bound grows by the drift of the own centroid and the lower one shrinks by the largest drift of another. While the
upper bound stays under the lower one, or under half the way from the own centroid to its nearest neighbour, no
other centroid can be as near and the vector keeps its cluster unseen. Only the ambiguous are scanned: first the own
distance makes the upper bound exact, then, if that doesn't settle it, all centroids are compared in exact integers.

A round reads and writes the state without a shuffle. Sums are carried from round to round: only vectors that changed their
cluster are added and taken away, in partial sums of each task, and what a shuffle adds up is a row for each cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import lean, materialize, remove, small_frame

#: Integers beyond this could overflow a squared distance of 64 components in a long.
LARGEST = 1 << 27
#: Bounds are doubles: what is within this share and amount of equality counts as ambiguous.
SHARE, AMOUNT = 1e-9, 1e-6
#: Vectors that a task handles at once.
CHUNK = 8192
STATE = ("id", "v", "cluster", "upper", "lower", "was", "scans")


def integer_vectors(df: DataFrame, vec_col: str, dims: int, scale: int) -> tuple[Column, Column]:
    """Whether a row's vector is usable (``dims`` components, none null or non-finite), and its integers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    v = F.col(f"`{vec_col}`")
    usable = F.coalesce((F.size(v) == dims) & F.forall(v, finite), F.lit(False))
    return usable, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dims)


def distances(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``v`` to one centroid each (or to the same)."""
    gap = v - centroid
    return np.einsum("ij,ij->i", gap, gap)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A full scan: the nearest centroid of each vector (of equals the first), its squared distance and the second-least."""
    all_of = np.stack([distances(v, c) for c in centroids], axis=1)
    best = all_of.argmin(axis=1)
    rows = np.arange(len(v))
    own = all_of[rows, best]
    if len(centroids) == 1:
        return best, own, np.full(len(v), np.iinfo(np.int64).max)
    all_of[rows, best] = np.iinfo(np.int64).max
    return best, own, all_of.min(axis=1)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(distances(a, b).astype(np.float64))


class Round:
    """One assignment of state rows to centroids that have moved since the last."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        k = len(centroids)
        self.centroids, self.first = centroids, before is None
        drift = np.zeros(k) if before is None else _gaps(centroids, before) * (1 + SHARE)
        self.drift = drift
        # The largest drift of any other centroid, for each.
        order = np.argsort(drift)
        self.others = np.full(k, drift[order[-1]])
        self.others[order[-1]] = drift[order[-2]] if k > 1 else 0.0
        apart = np.full((k, k), np.inf)
        for i in range(k):
            apart[i] = _gaps(centroids, np.broadcast_to(centroids[i], centroids.shape))
            apart[i, i] = np.inf
        self.half = apart.min(axis=1) / 2

    def __call__(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New clusters and bounds, and which rows took a full scan."""
        cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
        if self.first:
            doubtful = np.arange(len(v))
        else:
            upper += self.drift[cluster]
            lower -= self.others[cluster]
            safe = np.maximum(lower, self.half[cluster]) * (1 - SHARE) - AMOUNT
            tight = np.flatnonzero(upper >= safe)
            upper[tight] = np.sqrt(distances(v[tight], self.centroids[cluster[tight]]).astype(np.float64)) * (1 + SHARE)
            doubtful = tight[upper[tight] >= safe[tight]]
        scanned = np.zeros(len(v), bool)
        if len(doubtful):
            best, own, second = nearest(v[doubtful], self.centroids)
            cluster[doubtful] = best
            upper[doubtful] = np.sqrt(own.astype(np.float64)) * (1 + SHARE)
            lower[doubtful] = np.sqrt(second.astype(np.float64)) * (1 - SHARE)
            scanned[doubtful] = True
        return cluster, upper, lower, scanned


def _assign(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, tag: str) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Round(centroids, before)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                was, upper, lower, scans = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 6))
                cluster, upper, lower, scanned = step(_vectors(part.column(1), dims), was, upper, lower)
                columns = [pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(was), pa.array((scans + scanned).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], list(STATE))

    return materialize(state.mapInArrow(lean(run), state.schema), tag)


def _sums(v: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """The sum of the rows of each label from 0 to k - 1."""
    out = np.zeros((k, v.shape[1]), np.int64)
    if len(v):
        order = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.diff(label[order], prepend=-1))
        out[label[order][starts]] = np.add.reduceat(v[order], starts)
    return out


def _moved(state: DataFrame, k: int, dims: int) -> list[tuple[int, int, int]]:
    """(cluster, component, change of the sum) since the round before; component ``dims`` is the number of vectors.

    At most k * (dims + 1) rows come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            to, was = (batch.column(i).to_numpy() for i in (1, 2))
            v = np.column_stack([_vectors(batch.column(0), dims), np.ones(batch.num_rows, np.int64)])
            known = was >= 0
            total += _sums(v, to, k) - _sums(v[known], was[known], k)
        some = np.argwhere(total)
        columns = [pa.array(some[:, 0].astype(np.int32)), pa.array(some[:, 1].astype(np.int32)), pa.array(total[tuple(some.T)])]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "i", "n"])

    parts = state.where(F.col("cluster") != F.col("was")).select("v", "cluster", "was").mapInArrow(lean(run), "cluster int, i int, n long")
    summed = parts.groupBy("cluster", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    return [(r["cluster"], r["i"], int(r["n"])) for r in summed.collect()]


def cluster(
    df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans) of every row with a usable vector.

    A vector is usable if it has exactly ``dims`` components, none null or non-finite; other rows (null vectors too) are left
    out. Centroids start as the ``k`` usable vectors of the smallest sha256 of ``seed:id`` in that order; fewer if there are fewer. Equal ids (repeated
    rows) tie there and go by their components; null ids come last. Ties of distance go to the smaller number. An empty
    table, or one without usable vectors, gives no rows. Other columns aren't read, so their names can't clash. A component of
    magnitude above ``LARGEST / scale`` is a ``ValueError``: its squared distance may not fit into a long.
    ``scans`` counts the rounds (of ``rounds + 1``) in which all centroids were compared with the vector.
    """
    spark = df.sparkSession
    usable, integers = integer_vectors(df, vec_col, dims, scale)
    rows = df.where(usable).select(F.col(f"`{id_col}`").alias("id"), integers.alias("v"))
    high, low = rows.select(F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    if high is None:
        return _result(small_frame(spark, pa.table({"id": pa.array([], pa.int64())})).select(F.col("id").cast(rows.schema["id"].dataType)), id_col)
    if max(high, -low) > LARGEST:
        raise ValueError(f"a component of magnitude {max(high, -low) / scale:g} is too large for exact distances in longs")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(name.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in first], np.int64)
    k = len(centroids)
    none = F.lit(-1).cast("int")
    state = rows.select("id", "v", none.alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), none.alias("was"), F.lit(0).alias("scans"))
    before, sums = None, [[0] * (dims + 1) for _ in range(k)]
    for n in range(rounds + 1):
        after = _assign(state, centroids, before, f"clusters-{n}")
        if before is not None:
            remove(spark, state)
        state = after
        if n == rounds:
            break
        for c, i, change in _moved(state, k, dims):
            sums[c][i] += change
        before = centroids
        centroids = np.array([[x // s[dims] for x in s[:dims]] if s[dims] else list(before[c]) for c, s in enumerate(sums)], np.int64)
    return _measured(state, centroids, id_col)


def _measured(state: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    """The exact distance of each vector to its centroid, and what follows from all of them."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                own = centroids[part.column(2).to_numpy()]
                found = distances(_vectors(part.column(1), dims), own)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found), part.column(3)], ["id", "cluster", "distance", "scans"])

    kept = state.select("id", "v", "cluster", "scans")
    schema = T.StructType([state.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("scans", T.IntegerType())])
    out = materialize(kept.mapInArrow(lean(run), schema), "distances")
    remove(state.sparkSession, state)
    inertia = {r["cluster"]: r["n"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return _result(out, id_col, inertia, names)


def _result(rows: DataFrame, id_col: str, inertia: dict[int, int] | None = None, names: list[str] | None = None) -> DataFrame:
    if not inertia:
        null = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string", "scans": "int"}
        return rows.select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(n) for n, t in null.items()))
    own = F.create_map(*(x for c, n in inertia.items() for x in (F.lit(c), F.lit(n).cast("long"))))[F.col("cluster")]
    digest = F.array(*map(F.lit, names))[F.col("cluster")]
    return rows.select(
        F.col("id").alias(id_col), "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), digest.alias("centroid_sha256"), "scans"
    )
