"""Trees that stay in files: they are grown in tasks, written as Parquet rows to the shared folder, and read a few at a time by the tasks that score.

So no driver and no task holds a model, whose size is that of its rows and trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from ..session import scratch_path
from ..sources.workbook import files_of, opened
from .boosting import Grid, routed

#: Rows x trees from which trees are grown and kept so, and cells of the binned table up to which a task holds it.
FEW_GROWN, WHOLE_CELLS = 500_000, 100_000_000
#: Tasks that a model's trees are dealt to for each processor, and at most.
TASKS_EACH, MOST_TASKS = 2, 64
#: Rows and cells scored at a time, and trees read at a time.
SCORE_ROWS, SCORE_CELLS, READ_TREES = 200_000, 20_000_000, 8
TREE_SCHEMA = "tree int, nodes int, feature binary, bin binary, missing_left binary, `left` binary, value binary, cover binary"


def grows_here(n: int, n_features: int, n_trees: int) -> bool:
    """Whether a model of ``n`` rows is too large for the driver, and its rows few enough for a task."""
    return n * n_trees > FEW_GROWN and n * (n_features + 4) <= WHOLE_CELLS


@dataclass
class Grown:
    """A tree: feature (-1: leaf), bin and whether missing values go left, first child (the second follows it), values and rows of each node."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def row(self, tree: int) -> tuple:
        kinds = (np.int32, np.uint16, np.uint8, np.int32, np.float64, np.float64)
        return tree, len(self.feature), *(bytearray(a.astype(k).tobytes()) for a, k in zip((self.feature, self.bin, self.missing_left, self.left, self.value, self.cover), kinds))

    def arrays(self) -> tuple[np.ndarray, ...]:
        """In the form of :meth:`boosting.Tree.arrays`, without values."""
        return self.feature, self.bin.astype(np.int32), self.missing_left, self.left, self.left + 1, None


def from_row(row: dict) -> Grown:
    read = lambda name, kind: np.frombuffer(row[name], kind)
    value = read("value", np.float64)
    return Grown(read("feature", np.int32), read("bin", np.uint16), read("missing_left", np.uint8).astype(bool), read("left", np.int32), value.reshape(row["nodes"], -1), read("cover", np.float64))


def cell_sums(cell: np.ndarray, n_cells: int, weights: list[np.ndarray], each: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cells that hold rows, ascending, and the sums of each weight in them; weights are given for rows, which have ``each`` cells one behind the other."""
    if n_cells <= 4 * len(cell):
        sums = [np.bincount(cell, np.repeat(w, each), minlength=n_cells) for w in weights]
        at = np.flatnonzero(sums[0])
        return at, [s[at] for s in sums]
    place = np.sort(cell.astype(np.int64) << 32 | np.arange(len(cell)))
    cell, row = place >> 32, (place & 0xFFFFFFFF) // each
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[first], [np.add.reduceat(w[row], first) for w in weights]


@dataclass
class TreeFiles:
    """The trees of one model in Parquet files; ``cuts`` are the edges of the bins, by feature.

    With classes a node's numbers are their shares, and the score is the mean over the trees. With ``scale`` a node's number is its sum over its rows, times
    ``scale``, plus ``start``. Without it, the score is ``start`` and the sum of the values of the leaves.
    """

    path: str
    n_trees: int
    cuts: list[np.ndarray]
    classes: int = 0
    scale: float | None = None
    start: float = 0.0

    def copied(self, path: str) -> "TreeFiles":
        """The same trees in files of their own."""
        spark = SparkSession.active()
        spark.read.schema(TREE_SCHEMA).parquet(self.path).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return replace(self, path=path)

    def as_dict(self) -> dict:
        return {"n_trees": self.n_trees, "cuts": [c.tolist() for c in self.cuts], "classes": self.classes, "scale": self.scale, "start": self.start}

    @staticmethod
    def from_dict(d: dict, path: str) -> "TreeFiles":
        return TreeFiles(path, **d | {"cuts": [np.array(c, np.float64) for c in d["cuts"]]})

    def trees(self, group: int = 0, groups: int = 1) -> Iterator[Grown]:
        """All trees, or those of one of several groups, few at a time, in the order of the files."""
        import pyarrow.parquet as pq

        for name in sorted(f for f in files_of(self.path) if f.endswith(".parquet")):
            fs, inner = opened(name)
            with fs.open_input_file(inner) as f, pq.ParquetFile(f) as file:
                for batch in file.iter_batches(batch_size=READ_TREES):
                    for row in batch.to_pylist():
                        if row["tree"] % groups == group:
                            yield from_row(row)

    def leaves(self, bins: np.ndarray) -> Iterator[np.ndarray]:
        """What each tree says of rows in bins (features x rows), as if it were alone: rows x values."""
        for tree, at in self._reached(bins):
            yield self.numbers(tree)[at]

    def _reached(self, bins: np.ndarray) -> Iterator[tuple[Grown, np.ndarray]]:
        sizes = Grid(self.cuts).sizes
        for tree in self.trees():
            yield tree, routed(bins, sizes, tree.arrays())

    def numbers(self, tree: Grown) -> np.ndarray:
        """What the nodes of a tree say: nodes x values."""
        if self.classes:
            return tree.value / np.maximum(tree.value.sum(axis=1, keepdims=True), 1e-300)
        return tree.value * self.n_trees + self.start if self.scale is None else tree.value / tree.cover[:, None] * self.scale + self.start

    def told(self, bins: np.ndarray, spread: bool = False) -> np.ndarray:
        """Mean over the trees, rows x classes; or mean and deviation. Rows in the same bins are asked once."""
        if not bins.shape[1]:
            return np.zeros((0, max(self.classes, 2 if spread else 1)))
        lines = np.ascontiguousarray(bins.T)
        _, one, back = np.unique(lines.view(np.dtype((np.void, lines.shape[1] * lines.itemsize))).ravel(), return_index=True, return_inverse=True)
        bins, n, mean, square = np.ascontiguousarray(bins[:, one]), 0, 0.0, 0.0
        if self.scale is None and not self.classes and not spread:
            total = np.full((len(one), 1), self.start)
            for tree, at in self._reached(bins):
                total += tree.value[at]
            return total[back.ravel()]
        for said in self.leaves(bins):
            n += 1
            away = said - mean
            mean = mean + away / n
            square = square + away * (said - mean)
        out = np.concatenate([mean, np.sqrt(square / n)], axis=1) if spread else mean
        return out[back.ravel()]

    def scored(self, values: Column, spread: bool = False) -> Column:
        """An array of the numbers of :meth:`told`, from an array of feature values."""
        model = self

        @F.pandas_udf("array<double>")
        def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held, n, grid = [], 0, Grid(model.cuts)

            def out():
                said, low = model.told(np.concatenate(held, axis=1), spread), 0
                for part in held:
                    yield pd.Series(list(said[low:low + part.shape[1]]), dtype=object)
                    low += part.shape[1]

            for batch in batches:
                held.append(grid.binned(np.vstack(batch.to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, len(model.cuts)))))
                n += len(batch)
                if n >= SCORE_ROWS or n * len(model.cuts) >= SCORE_CELLS:
                    yield from out()
                    held, n = [], 0
            if held:
                yield from out()

        return told(values)


def keep_trees(spark: SparkSession, trees) -> str:
    """Write an RDD of :meth:`Grown.row` to the shared folder; the path."""
    path = scratch_path(spark, "trees")
    spark.createDataFrame(trees, TREE_SCHEMA, verifySchema=False).write.option("compression", "zstd").parquet(path)
    return path


def dealt_trees(blocks, n_trees: int, grow: Callable):
    """RDD of what ``grow`` makes of all blocks and a range of trees; the ranges are dealt to tasks, in order."""
    tasks = max(1, min(n_trees, MOST_TASKS, TASKS_EACH * blocks.context.defaultParallelism))

    def copied(block):
        for k in range(tasks):
            yield k, block

    def grown(pair):
        k, own = pair
        return grow(list(own), range(n_trees * k // tasks, n_trees * (k + 1) // tasks))

    return blocks.flatMap(copied).groupByKey(tasks, lambda k: k).flatMap(grown)
