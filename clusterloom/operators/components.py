"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.plans.scratch import Scratch


#: edges that a task contracts at a time
CHUNK = 1 << 20


def merge_classes(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of i and j pairwise; root[x] is the smallest member of x's class, before and after."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to stars with the same components, CHUNK edges at a time."""
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = merge_classes(np.arange(len(nodes)), places[: len(u)], places[len(u) :])
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["u", "v"])

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
        size += batch.num_rows
        if size >= CHUNK:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def _closest(edges: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours; partial sums keep hubs out of one task."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _closest(both)
    far = both.where("v > u")
    return far.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _closest(down)
    hung = down.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, one_task: int = CHUNK, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    `edges` has columns u and v of type bigint; direction, repetition and loops do not matter (a
    node with only loops is left out, as it is not linked to another one), rows with a null end are
    ignored.  An empty table gives an empty result.

    Each task first contracts its own edges to stars.  If no more than `one_task` edges are left, one more
    task of that bounded size contracts them all.  Else large-star and small-star steps alternate until
    the edge table no longer changes; each is one aggregation with map-side combine and one equi-join
    that AQE can split where a hub is hot, so no node's neighbours meet in one task.  Every step's result
    is written to the shared folder; the last of them, which the result reads, belongs to `scratch` if given.
    """
    scratch = scratch.inner("components") if scratch else Scratch(edges.sparkSession, "components")
    linked = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    now = scratch.save(linked.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    mark = _fingerprint(now)
    if 0 < mark[0] <= min(one_task, CHUNK):
        now = scratch.save(now.coalesce(1).mapInArrow(_contract, "u long, v long"), "edges")
    elif mark[0]:
        was = None
        while mark != was:
            now = scratch.save(_large_star(now), "large")
            now = scratch.save(_small_star(now), "edges")
            was, mark = mark, _fingerprint(now)
    scratch.drop("large")
    # A settled table holds one edge from each node to its root.
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum of an edge table without repeated rows."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)
