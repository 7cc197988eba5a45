"""Connected components of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resultloom.operators.skew import lookup
from resultloom.runtime import discard, materialize

# Edges that a task reduces to a forest at once. It bounds a task, not the answer.
TASK_EDGES = 2_000_000


def least_reachable(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """For each of the numbers 0 .. nodes - 1 the least one it is connected to by edges (a, b).

    Roots hook to the least root next to them and every path is cut to its root, all at once, until
    no edge joins two roots; the number of passes grows with the logarithm of the nodes.
    """
    root = np.arange(nodes)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        np.minimum.at(root, high, low)
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above


def _forest(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars of their least nodes, ``limit`` edges at a time."""

    def stars(child: list, parent: list) -> pa.RecordBatch:
        child, parent = pa.chunked_array(child), pa.chunked_array(parent)
        names = pc.unique(pa.chunked_array([*child.chunks, *parent.chunks]))
        # Numbers in the order of the names, so that the least number has the least name.
        names = names.take(pc.sort_indices(names))
        a, b = [np.asarray(pc.index_in(c, value_set=names)) for c in (child, parent)]
        root = least_reachable(a, b, len(names))
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.record_batch([names.take(pa.array(moved)), names.take(pa.array(root[moved]))], names=["child", "parent"])

    child, parent, held = [], [], 0
    for batch in batches:
        child.append(batch.column("child"))
        parent.append(batch.column("parent"))
        held += batch.num_rows
        if held >= limit:
            kept = stars(child, parent)
            if kept.num_rows > limit // 2:
                # Many nodes: what is known of them leaves the task.
                yield kept
                child, parent, held = [], [], 0
            else:
                child, parent, held = [kept.column("child")], [kept.column("parent")], kept.num_rows
    if held:
        yield stars(child, parent)


def _is_star_forest(edges: DataFrame) -> bool:
    """True when every node has one parent or is a parent, never both."""
    roles = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                F.struct(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
            )
        ).alias("r")
    ).select("r.*")
    clash = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return clash.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _hook(edges: DataFrame, least_only: bool) -> DataFrame:
    """Attach neighbours of each node to the least node around it.

    ``least_only`` moves the neighbours below a node (small star), otherwise
    those above it (large star). Minima are taken per task before the shuffle and
    no neighbour list is ever gathered.
    """
    down = edges.select(F.col("child").alias("node"), F.col("parent").alias("other"))
    if least_only:
        seen = down
    else:
        seen = down.unionByName(
            edges.select(F.col("parent").alias("node"), F.col("child").alias("other"))
        )
    least = seen.groupBy("node").agg(F.min("other").alias("least"))
    least = least.withColumn("least", F.least("least", "node"))
    moved = lookup(seen, least, ["node"])
    if least_only:
        own = least.select(F.col("node").alias("child"), F.col("least").alias("parent"))
        moved = moved.select(F.col("other").alias("child"), F.col("least").alias("parent"))
        moved = moved.unionByName(own)
    else:
        moved = moved.filter(F.col("other") > F.col("node")).select(
            F.col("other").alias("child"), F.col("least").alias("parent")
        )
    return moved.filter(F.col("child") != F.col("parent")).distinct()


def components(edges: DataFrame, *, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its least node.

    Every task first reduces its own edges to stars, before anything is shuffled: copies of an edge, and
    paths within a task, are gone after that. If what is left fits one task, as counted, that
    task joins the stars. Otherwise large-star and small-star steps (Kiveris et al., 2014)
    alternate, with a reduction in each task after every pair of them, until the edges fit one
    task or each node hangs from its root. Every round is written to the shared folder, so a
    lost executor costs one round; only counts come back to the driver. Edges with a null end
    and loops are left out.
    """
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("child", kind), T.StructField("parent", kind)])

    def reduced(frame: DataFrame) -> DataFrame:
        return frame.mapInArrow(lambda batches: _forest(batches, task_edges), schema)

    ordered = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
    current = materialize(reduced(ordered), "edges")
    while True:
        if current.count() <= task_edges:
            before, current = current, materialize(reduced(current.coalesce(1)), "edges")
            discard(before)
            break
        if _is_star_forest(current):
            break
        before, current = current, materialize(reduced(_hook(_hook(current, False), True)), "edges")
        discard(before)
    roots = current.select(F.col("parent").alias("node")).distinct()
    return current.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )
