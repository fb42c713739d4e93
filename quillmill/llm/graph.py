"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, stored

#: Edges that one task contracts.
TASK_EDGES = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Each of so many tasks replaces its edges by stars: one edge from each node to the smallest it reaches by them."""
    kind = edges.schema["a"].dataType.simpleString()

    def each(batches):
        parts = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches if x.num_rows]
        if parts:
            a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = forest(place[: len(a)], place[len(a) :], len(nodes))
            at = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[root[at]])], ["a", "b"])

    return edges.coalesce(tasks).mapInArrow(each, f"a {kind}, b {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) for every node of an edge; a component is named by its smallest node.

    Edges are first contracted in tasks of about `task_edges` each. What is left goes through alternating large-star and
    small-star rounds, each a few joins, until the edges stay the same; if one task held all edges, nothing is left to do. Only
    counts come to the driver. Edges from a node to itself and nulls are ignored.
    """
    given = cut_lineage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b"))
    tasks = max(1, -(-given.count() // task_edges))
    now = cut_lineage(_contracted(given, tasks))
    while tasks > 1:
        new = stored(_small_star(_large_star(now)))
        same = new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty()
        now = new
        if same:
            break
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(pairs.select(F.col("component"), F.col("component")).distinct())


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new
