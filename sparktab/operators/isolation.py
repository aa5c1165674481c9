"""Isolation forest: trees are grown per hash sample in parallel and scored batch by batch."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .quantiles import quantiles

EULER_GAMMA = 0.5772156649015329  # Fixed value.


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    grown = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER_GAMMA) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, grown))


def grow_tree(x: np.ndarray, seed: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, path); a leaf has feature -1 and its path length."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[tuple[int, float, int, int, float]] = []
    pending = [(x, 0, -1, False)]
    while pending:
        rows, depth, parent, is_right = pending.pop()
        me = len(nodes)
        if parent >= 0:
            f, cut, left, right, path = nodes[parent]
            nodes[parent] = (f, cut, left, me, path) if is_right else (f, cut, me, right, path)
        spans = rows.max(0) - rows.min(0) if len(rows) else np.zeros(x.shape[1])
        live = np.flatnonzero(spans > 0)
        if depth >= limit or len(rows) <= 1 or not len(live):
            nodes.append((-1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        f = int(rng.choice(live))
        low, high = rows[:, f].min(), rows[:, f].max()
        cut = float(rng.uniform(low, high))
        nodes.append((f, cut, -1, -1, 0.0))
        goes_left = rows[:, f] <= cut
        pending.append((rows[~goes_left], depth + 1, me, True))
        pending.append((rows[goes_left], depth + 1, me, False))
    return nodes


def path_lengths(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Walk all rows down one tree together."""
    at = np.zeros(len(x), dtype=int)
    while True:
        feature = nodes[at, 0].astype(int)
        moving = np.flatnonzero(feature >= 0)
        if not len(moving):
            return nodes[at, 4]
        here = at[moving]
        left = x[moving, feature[moving]] <= nodes[here, 1]
        at[moving] = np.where(left, nodes[here, 2], nodes[here, 3]).astype(int)


@dataclass
class IsolationForest:
    cols: list[str]
    trees: list[np.ndarray]
    sample_size: int
    threshold: float | None = None

    def score_column(self):
        trees, cols = self.trees, self.cols
        usual = float(average_path(self.sample_size))

        @F.pandas_udf("double")
        def score(frame: pd.DataFrame) -> pd.Series:
            x = frame[cols].to_numpy(dtype=float)
            if not len(x):
                return pd.Series([], dtype=float)
            depth = np.mean([path_lengths(x, t) for t in trees], axis=0)
            return pd.Series(np.exp2(-depth / usual) if usual > 0 else np.full(len(x), 0.5))

        return score(F.struct(*[F.col(c).cast("double").alias(c) for c in cols]))

    def score(self, df: DataFrame, names: tuple[str, str, str] = ("score", "flag", "cluster")) -> DataFrame:
        """Add a score and a flag."""
        scored = df.withColumn(names[0], self.score_column())
        return scored.withColumn(names[1], (F.col(names[0]) > F.lit(self.threshold)).cast("int"))


def _tree_samples(df: DataFrame, cols, row_id: str, n_trees: int, rows_per_tree: int, seed) -> DataFrame:
    """A hash sample per tree: a threshold thins the table first, then exactly ``rows_per_tree`` rows are kept.

    Thinning keeps a bounded number of rows however large the table is.
    """
    total = df.count()
    share = min(1.0, 4.0 * rows_per_tree / max(total, 1))
    bound = int(share * (1 << 62)) if share < 1 else None
    ident = F.col(row_id).cast("string")
    draw = lambda t: F.xxhash64(F.lit(str(seed)), t, ident).bitwiseAND(F.lit((1 << 62) - 1))
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    wanted = trees if bound is None else F.filter(trees, lambda t: draw(t) < F.lit(bound))
    drawn = df.select(row_id, *cols, F.explode(wanted).alias("tree")).withColumn("_d", draw(F.col("tree")))
    w = W.partitionBy("tree").orderBy("_d", row_id)
    return drawn.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows_per_tree)


def fit_isolation_forest(
    df: DataFrame, cols: Sequence[str], row_id: str, contamination: float | None = 0.05,
    n_trees: int = 100, rows_per_tree: int = 256, seed: int = 42,
) -> IsolationForest:
    """``df`` must have no missing value in ``cols``."""
    cols = list(cols)
    sample = _tree_samples(df, cols, row_id, n_trees, rows_per_tree, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        tree = int(pdf["tree"].iloc[0])
        nodes = grow_tree(pdf[cols].to_numpy(dtype=float), seed + tree)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"]).astype(float)
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        out["rows"] = len(pdf)
        return out

    schema = "tree int, node int, feature double, cut double, left double, right double, path double, rows int"
    # At most n_trees * 2 * rows_per_tree nodes.
    nodes = sample.groupBy("tree").applyInPandas(grow, schema).toPandas().sort_values(["tree", "node"])
    trees = [g[["feature", "cut", "left", "right", "path"]].to_numpy() for _, g in nodes.groupby("tree")]
    forest = IsolationForest(cols, trees, int(nodes["rows"].max()) if len(nodes) else 1)
    if contamination is not None:
        scored = df.select(forest.score_column().alias("score")).persist()
        forest.threshold = quantiles(scored, {"t": (F.col("score"), [1 - contamination])})["t"][0]
        scored.unpersist()
    return forest
