"""Exact Shapley values of tree ensembles, row by row.

The value of a set of features is the tree's mean where splits on other features are followed on both sides, weighted by their training rows. A leaf
asks each feature of its path for one interval; with ``o`` (the row lies in it) and ``z`` (share of rows that do) its part of a feature's value is a
sum over the coefficients of the product of ``z + o t`` over the other features of the path. So a leaf costs the square of its path's features, not
the number of their sets. Leaves with as many features are worked on together for a batch of rows; the model travels with the tasks, rows are dealt
out by rows x leaves.

Trees in files are dealt out too: a task takes some trees and a block of rows, equal ones once, in bins. What a leaf of few path features gives depends only on which of
its intervals hold the row, so it is worked out once for each such set and looked up by the rows; values are summed up block by block.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.boosting import Grid
from ..operators.tree_files import Grown, TreeFiles
from ..session import cut_lineage
from .surrogate import PackedForest

#: Cells (leaves x rows) held at a time, and those of a task.
CELLS, TASK_CELLS = 200_000, 40_000_000
#: Path features up to which a leaf's values are looked up, rows of a block, and tasks that trees are dealt to.
LOOKED_UP, SHAPLEY_ROWS, TREE_TASKS = 8, 1 << 15, 24


@dataclass
class Leaves:
    """Leaves with m path features each: features, intervals (low, high], shares and leaf values."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def leaf_table(forest: PackedForest) -> tuple[float, list[Leaves]]:
    """The mean prediction, and all leaves by the number of features on their paths; values of averaged forests are divided by the number of trees."""
    scale = 1.0 / len(forest.root) if forest.averaged else 1.0
    found: dict[int, list[tuple]] = defaultdict(list)
    mean = forest.base
    for root in forest.root.tolist():
        line: list[tuple[int, float, dict]] = [(root, 1.0, {})]
        while line:
            node, reach, path = line.pop()
            if forest.feature[node] < 0:
                value = float(forest.value[node]) * scale
                mean += reach * value
                found[len(path)].append((value, path))
                continue
            f, cut = int(forest.feature[node]), float(forest.cut[node])
            for child, is_left in ((int(forest.left[node]), True), (int(forest.right[node]), False)):
                part = float(forest.cover[child] / forest.cover[node]) if forest.cover[node] else 0.0
                if part == 0.0:
                    continue  # no training row went there, so the mean doesn't either
                low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
                own = (low, min(high, cut), share * part) if is_left else (max(low, cut), high, share * part)
                line.append((child, reach * part, {**path, f: own}))
    table = []
    for m, leaves in sorted(found.items()):
        if m:
            cells = np.array([[(f, *p) for f, p in path.items()] for _, path in leaves], np.float64).reshape(len(leaves), m, 4)
            table.append(Leaves(cells[..., 0].astype(np.int64), cells[..., 1], cells[..., 2], cells[..., 3], np.array([v for v, _ in leaves])))
    return mean, table


def shapley_rows(x: np.ndarray, table: list[Leaves]) -> np.ndarray:
    """Shapley values, rows x features."""
    out = np.zeros_like(x, dtype=np.float64)
    for leaves in table:
        m = leaves.feature.shape[1]
        weight = [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]
        step = max(1, CELLS // max(len(x), 1))
        for k in range(0, len(leaves.value), step):
            feature, low, high, z, value = (a[k:k + step] for a in (leaves.feature, leaves.low, leaves.high, leaves.share, leaves.value))
            v = x[:, feature]  # rows x leaves x m
            o = ((v > low) & (v <= high)).astype(np.float64)
            product = np.zeros((m + 1, *o.shape[:2]))
            product[0] = 1.0
            for j in range(m):
                product[1:j + 2] = product[1:j + 2] * z[:, j] + product[:j + 1] * o[..., j]
                product[0] *= z[:, j]
            for j in range(m):
                inside = o[..., j] > 0
                rest = np.zeros(o.shape[:2])
                q = np.zeros(o.shape[:2])
                for s in range(m - 1, -1, -1):  # the product without feature j, from its highest coefficient down
                    q = np.where(inside, product[s + 1] - z[:, j] * q, product[s] / z[:, j])
                    rest += weight[s] * q
                part = value * (o[..., j] - z[:, j]) * rest
                for f in np.unique(feature[:, j]):
                    out[:, f] += part[:, feature[:, j] == f].sum(axis=1)
    return out


def grown_leaves(tree: Grown, value: np.ndarray, sizes: np.ndarray) -> tuple[float, list[Leaves]]:
    """The mean of one tree, and its leaves by the number of features on their paths; intervals are those of bins."""
    p, mean, found = len(sizes), 0.0, defaultdict(list)
    nodes, reach = np.zeros(1, np.int64), np.ones(1)
    low, high, share, on_path = np.full((1, p), -1.0), np.full((1, p), np.inf), np.ones((1, p)), np.zeros((1, p), bool)
    while len(nodes):
        feature = tree.feature[nodes]
        at = np.flatnonzero(feature < 0)
        mean += float(reach[at] @ value[nodes[at]])
        many = on_path[at].sum(axis=1)
        for m in np.unique(many[many > 0]).tolist():
            own = at[many == m]
            f = np.nonzero(on_path[own])[1].reshape(len(own), m)
            k = own[:, None]
            found[m].append(Leaves(f, low[k, f], high[k, f], share[k, f], value[nodes[own]]))
        up = np.flatnonzero(feature >= 0)
        f, cut, parts = feature[up], tree.bin[nodes[up]].astype(float), []
        line = np.arange(len(up))
        for side in (0, 1):
            child = tree.left[nodes[up]].astype(np.int64) + side
            part = tree.cover[child] / tree.cover[nodes[up]]
            lo, hi, sh, on = low[up], high[up], share[up], on_path[up]
            if side:
                lo[line, f] = np.maximum(lo[line, f], cut)
            else:
                hi[line, f] = np.minimum(hi[line, f], cut)
            sh[line, f] *= part
            on[line, f] = True
            parts.append((child, reach[up] * part, lo, hi, sh, on))
        nodes, reach, low, high, share, on_path = (np.concatenate(a) for a in zip(*parts))
    return mean, [Leaves(*(np.concatenate([getattr(x, c) for x in some]) for c in ("feature", "low", "high", "share", "value"))) for _, some in sorted(found.items())]


def leaf_values(leaves: Leaves) -> np.ndarray:
    """Values of the path features by the set of intervals that hold a row: leaves x sets x features; bit j of a set is the j-th feature."""
    m = leaves.feature.shape[1]
    weight = [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]
    o = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(np.float64)[:, None]  # sets x 1 x m
    z = leaves.share[None]  # 1 x leaves x m
    out = np.empty((len(leaves.value), 1 << m, m))
    for j in range(m):
        others = np.zeros((m, 1 << m, len(leaves.value)))  # the product over the other features
        others[0] = 1.0
        for n, i in enumerate(i for i in range(m) if i != j):
            others[1:n + 2] = others[1:n + 2] * z[..., i] + others[:n + 1] * o[..., i]
            others[0] *= z[..., i]
        rest = np.tensordot(weight, others, 1)
        out[:, :, j] = (leaves.value * (o[..., j] - z[..., j]) * rest).T
    return out


def shapley_bins(bins: np.ndarray, table: list[Leaves], width: int, out: np.ndarray) -> None:
    """Add the values of the rows in bins (features x rows) to ``out`` (rows x features)."""
    number = np.arange(width)
    for leaves in table:
        m = leaves.feature.shape[1]
        if m > LOOKED_UP:
            out += shapley_rows(bins.T.astype(np.float64), [leaves])
            continue
        held = ((number > leaves.low[..., None]) & (number <= leaves.high[..., None])).astype(np.uint8) << np.arange(m, dtype=np.uint8)[:, None]  # leaves x m x bins
        step = max(1, CELLS // ((1 << m) * m))
        for k in range(0, len(leaves.value), step):
            piece = Leaves(*(a[k:k + step] for a in (leaves.feature, leaves.low, leaves.high, leaves.share, leaves.value)))
            for f, sets, values in zip(piece.feature, held[k:k + step], leaf_values(piece)):
                inside = np.take(sets[0], bins[f[0]])
                for j in range(1, m):
                    inside |= np.take(sets[j], bins[f[j]])
                out[:, f] += np.take(values, inside, axis=0)


def files_shapley(df: DataFrame, files: TreeFiles, keep: Sequence[str], features: str) -> DataFrame:
    """:func:`tree_shapley` of trees in files: blocks of rows meet each group of trees in a task of its own."""
    spark, p, n_trees = df.sparkSession, len(files.cuts), files.n_trees
    rows = df.select(*keep, vector_to_array(features).alias("_x"))
    schema = rows.drop("_x").schema.add("phi", T.ArrayType(T.DoubleType())).add("base", T.DoubleType())
    grid = Grid(files.cuts)
    sizes, width = grid.sizes, int(grid.sizes.max())

    def pack(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, SHAPLEY_ROWS):
                piece = batch.slice(low, SHAPLEY_ROWS)
                bins = grid.binned(piece["_x"].flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, p))
                kept = pa.RecordBatch.from_arrays([piece[c] for c in keep], list(keep))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept.schema) as writer:
                    writer.write_batch(kept)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([bins.tobytes()], pa.binary()), pa.array([piece.num_rows])], ["kept", "bins", "n"])

    # Arrow batches are small; rows are dealt so that a block is one batch, and written down so that its parts belong together.
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SHAPLEY_ROWS))
    try:
        blocks = cut_lineage(rows.mapInArrow(pack, "kept binary, bins binary, n long").withColumn("block", F.monotonically_increasing_id()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    groups = min(n_trees, TREE_TASKS)

    def dealt(row):
        for k in range(groups):
            yield k, row["block"], bytes(row["bins"]), row["n"]

    def valued(parts):
        for k, block, packed, n in parts:
            bins = np.frombuffer(packed, grid.kind).reshape(p, n)
            lines = np.ascontiguousarray(bins.T)
            _, one, back = np.unique(lines.view(np.dtype((np.void, lines.shape[1] * lines.itemsize))).ravel(), return_index=True, return_inverse=True)
            some, base = np.ascontiguousarray(bins[:, one]), 0.0
            phi = np.zeros((len(one), p))
            for tree in files.trees(k, groups):
                mean, table = grown_leaves(tree, files.numbers(tree)[:, 0] / n_trees, sizes)
                base += mean
                shapley_bins(some, table, width, phi)
            yield block, (base, phi[back.ravel()])

    n_blocks = blocks.count()
    summed = blocks.rdd.flatMap(dealt).map(lambda x: ((x[0], x[1]), x)).partitionBy(max(1, n_blocks * groups), lambda key: key[0] + groups * (key[1] % max(n_blocks, 1))).values().mapPartitions(
        valued).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), max(1, n_blocks))
    told = spark.createDataFrame(summed.map(lambda x: (x[0], float(x[1][0]), bytearray(x[1][1].tobytes()))), "block long, base double, phi binary", verifySchema=False)

    def unpack(batches):
        for batch in batches:
            for kept, base, phi in zip(*(batch[c].to_pylist() for c in ("kept", "base", "phi"))):
                own = pa.ipc.open_stream(kept).read_all().combine_chunks().to_batches()
                values = np.frombuffer(phi, np.float64)
                n = len(values) // p
                yield pa.RecordBatch.from_arrays(
                    [*(own[0][c] for c in keep), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p), pa.array(values)), pa.array(np.full(n, base))], [*keep, "phi", "base"])

    return blocks.select("block", "kept").join(told, "block").mapInArrow(unpack, schema)


def tree_shapley(df: DataFrame, forest: PackedForest | TreeFiles, keep: Sequence[str], features: str = "features") -> DataFrame:
    """``keep``, then ``phi`` (a value for each feature) and ``base``, the mean prediction: base and values sum to the prediction."""
    if isinstance(forest, TreeFiles):
        return files_shapley(df, forest, keep, features)
    base, table = leaf_table(forest)
    n_leaves = sum(len(t.value) for t in table)
    rows = df.select(*keep, vector_to_array(features).alias("_x"))
    tasks = max(1, -(-rows.count() * max(n_leaves, 1) // TASK_CELLS))
    schema = rows.drop("_x").schema.add("phi", T.ArrayType(T.DoubleType())).add("base", T.DoubleType())

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                piece = batch.slice(low, 256)
                x = piece["_x"].flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
                phi = shapley_rows(x, table)
                yield pa.RecordBatch.from_arrays(
                    [*(piece[c] for c in keep), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(phi.ravel())), pa.array(np.full(len(x), base))],
                    [*keep, "phi", "base"])

    return rows.repartition(tasks).mapInArrow(run, schema)


def shapley_ranking(df: DataFrame, forest: PackedForest | TreeFiles, names: Sequence[str], row_id: str) -> DataFrame:
    """Mean absolute Shapley value of each feature."""
    each = tree_shapley(df, forest, [row_id]).select(F.posexplode("phi").alias("j", "phi"))
    return each.groupBy("j").agg(F.avg(F.abs("phi")).alias("mean_abs_shap")).select(F.get(F.array(*map(F.lit, names)), F.col("j")).alias("feature"), "mean_abs_shap")
