"""File trees: parents, paths, ancestors, subtrees."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.sources.scratch import store

ORPHANS = "/(orphans)"


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage within a loop by a table in the shared folder."""
    return store(df, "level")


def resolve_parents(nodes: DataFrame) -> DataFrame:
    """(id, name, parent): the first listed parent that exists and isn't the node itself; null if there is none."""
    ids = nodes.select(F.col("id").alias("pid")).distinct()
    listed = nodes.select("id", F.posexplode("parents").alias("pos", "pid")).where(F.col("pid") != F.col("id"))
    first = listed.join(ids, "pid").groupBy("id").agg(F.min_by("pid", "pos").alias("parent"))
    return nodes.select("id", "name", (F.size(F.coalesce("parents", F.array().cast("array<string>"))) > 0).alias("listed")).join(first, "id", "left")


def _climb(nodes: DataFrame, start: dict[str, Column], above: dict[str, Callable[[Column, Column], Column]]) -> tuple[DataFrame, DataFrame]:
    """What each node has gathered up to its root (id, parent, gathered columns), and the nodes that only cycles reach (id, parent, name).

    Path doubling, as many rounds as the depth's logarithm. Each node starts with ``start`` (of id, name, lost) and knows the next node (``hop``)
    above what it has gathered; a round puts that one's own part before its own (``above``), which doubles the way. A node of depth d ends after
    log2(d) rounds; as every depth below it ends before, a round in which none ends leaves only cycles. Leaves are above no one and aren't looked up.
    """
    found = resolve_parents(nodes)
    inner = found.select(F.col("parent").alias("id")).where(F.col("id").isNotNull()).distinct().withColumn("inner", F.lit(True))
    tree = _cut(found.join(inner, "id", "left"))
    lost = F.col("listed") & F.col("parent").isNull()
    state = tree.withColumn("lost", lost).select("id", "parent", F.col("parent").alias("hop"), "inner", *(c.alias(n) for n, c in start.items()))
    done = state.where(F.col("hop").isNull())
    going = state.where(F.col("hop").isNotNull())
    known = state
    while True:
        up = known.where("inner").select(F.col("id").alias("hop"), F.col("hop").alias("next"), F.struct(*start).alias("up"))
        moved = _cut(going.join(up, "hop").select("id", "parent", F.col("next").alias("hop"), "inner", *(above[n](F.col(f"up.{n}"), F.col(n)).alias(n) for n in start)))
        ended = moved.where(F.col("hop").isNull())
        if not ended.limit(1).count():
            break
        done = done.unionByName(ended)
        going = moved.where(F.col("hop").isNotNull())
        known = done.unionByName(going)
    return done.drop("hop", "inner"), tree.join(done.select("id"), "id", "left_anti").select("id", "parent", "name")


def resolve_paths(nodes: DataFrame) -> DataFrame:
    """(id, parent, path, depth, ancestors, orphan) by path doubling (``_climb``).

    A root is a node that lists no parents. A node that lists parents of which none exists, or that only cycles reach,
    is an orphan. ``ancestors`` runs from the root to the parent: the result itself grows with the depth of each node (``resolve_roots`` doesn't).
    """
    joined = lambda up, own: F.when(up.isNull(), own).when(own.isNull(), up).otherwise(F.concat(up, F.lit("/"), own))
    start = {"names": F.col("name"), "chain": F.array("id"), "lost": F.col("lost")}
    done, cycles = _climb(nodes, start, {"names": joined, "chain": F.concat, "lost": lambda up, own: up})
    names = F.coalesce("names", F.lit(""))
    found = done.select(
        "id", "parent", F.concat(F.when(F.col("lost"), F.lit(ORPHANS + "/")).otherwise(F.lit("/")), names).alias("path"), (F.size("chain") - 1).alias("depth"),
        F.slice("chain", F.lit(1), F.size("chain") - 1).alias("ancestors"), F.col("lost").alias("orphan"),
    )
    none = F.array().cast("array<string>")
    rest = cycles.select("id", "parent", F.concat(F.lit(ORPHANS + "/"), "name").alias("path"), F.lit(0).alias("depth"), none.alias("ancestors"), F.lit(True).alias("orphan"))
    return found.unionByName(rest)


def resolve_roots(nodes: DataFrame) -> DataFrame:
    """(id, root, above, depth, orphan): the first and the last of each node's ancestors and how many there are, by path doubling (``_climb``).

    As ``resolve_paths``, but what a round moves are rows of one size, however deep the tree is.
    """
    start = {"top": F.col("id"), "depth": F.lit(0), "lost": F.col("lost")}
    done, cycles = _climb(nodes, start, {"top": lambda up, own: up, "depth": lambda up, own: up + own + 1, "lost": lambda up, own: up})
    has = F.col("depth") > 0
    found = done.select("id", F.when(has, F.col("top")).alias("root"), F.when(has, F.col("parent")).alias("above"), "depth", F.col("lost").alias("orphan"))
    none = F.lit(None).cast("string")
    return found.unionByName(cycles.select("id", none.alias("root"), none.alias("above"), F.lit(0).alias("depth"), F.lit(True).alias("orphan")))


def subtree(nodes: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """(id, depth) below ``root``, breadth first; cycles end where a node was seen."""
    edges = nodes.select("id", F.explode("parents").alias("parent")).distinct()
    level = nodes.where(F.col("id") == root).select("id", F.lit(0).alias("depth"))
    done, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        up = level.select(F.col("id").alias("parent"))
        level = _cut(edges.join(up, "parent", "left_semi").select("id").distinct().join(done.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        if not level.limit(1).count():
            break
        done = done.unionByName(level)
    return done


def shortcut_targets(nodes: DataFrame) -> DataFrame:
    """Shortcuts with the node that they point to (null if it isn't there)."""
    targets = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return nodes.where(F.col("target").isNotNull()).select("id", F.col("target").alias("target_id")).join(targets, "target_id", "left").select("id", "target_id", "target_name")


def parent_path(path: str) -> str:
    return posixpath.dirname(path)
