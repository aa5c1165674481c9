"""Connected components of an edge table, by rounds of joins that hang every node on the smallest one it can reach."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

_EDGE = "a bigint, b bigint"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of their component, and that smallest node, for the edges of one task."""
    nodes, own = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = own[:len(a)], own[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _shrunk(batches):
    """Each task's edges as a forest; flushed at a set size."""
    parts, size = [], 0
    for batch in batches:
        parts.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
        size += batch.num_rows
        if size > 2_000_000:
            a, b = forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            parts, size = [(a, b)], 0
            if len(a) > 1_000_000:
                yield pa.record_batch({"a": a, "b": b})
                parts = []
    if parts:
        a, b = forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield pa.record_batch({"a": a, "b": b})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node of its component."""
    now = cut_lineage(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_shrunk, _EDGE).distinct())
    state = None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
        if not row["n"]:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        now = cut_lineage(hung.where("a <> b").distinct())
    rooted = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return rooted.unionAll(rooted.select(F.col("root").alias("node"), "root").distinct())
