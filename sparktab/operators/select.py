"""Feature selectors.  Each returns the names it keeps; applying one is a projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import shared_checkpoints
from .split import with_balanced_weight
from .stats import long_form


def anova_f(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """``(column, f_value)``: between-class over within-class variance.

    One scan gives counts, means and centred squares per (column, class). Means
    are compared with the smallest one of their column before they are squared,
    so an offset common to all values leaves the result as it is.
    """
    parts = long_form(df, cols, [label]).where(F.col("value").isNotNull() & F.col(label).isNotNull()).groupBy("column", label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    column = W.partitionBy("column")  # one row for each class
    parts = parts.withColumn("d", F.col("m") - F.min("m").over(column))
    parts = parts.withColumn("grand", F.sum(F.col("n") * F.col("d")).over(column) / F.sum("n").over(column))
    sums = parts.groupBy("column").agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * (F.col("d") - F.col("grand")) * (F.col("d") - F.col("grand"))).alias("between"),
    )
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("N") - F.col("k")))
    return sums.select("column", F.when(F.col("k") > 1, f).alias("f_value"))


def select_k_best(df: DataFrame, cols: Sequence[str], label: str, k=10) -> list[str]:
    """Columns with the k highest F values, in input order; a k that is not a whole number keeps all."""
    cols = list(cols)
    if not isinstance(k, int) or isinstance(k, bool) or k >= len(cols):
        return cols
    scores = {r["column"]: r["f_value"] for r in anova_f(df, cols, label).collect()}
    ranked = sorted(cols, key=lambda c: (-(scores.get(c) if scores.get(c) is not None else -1.0), cols.index(c)))
    return [c for c in cols if c in set(ranked[:k])]


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    doubles = df.withColumns({c: F.col(c).cast("double") for c in cols})
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(doubles)


#: Steps of coordinate descent inside one Newton step, and halvings of a step that doesn't pay.
INNER_SWEEPS, HALVINGS = 1000, 30


def _margin_sums(data: DataFrame, d: int, weights: np.ndarray, C: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Squared hinge loss, its gradient and its Hessian at ``weights``, summed by place; only d^2 + d + 1 numbers meet anywhere."""
    def part(batches):
        total = np.zeros(1 + d + d * d)
        for batch in batches:
            y = batch["y"].to_numpy(zero_copy_only=False)
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(y), d)
            slack = 1.0 - y * (x @ weights)
            at = slack > 0
            xa, ya, sa = x[at], y[at], slack[at]
            total[0] += C * float(sa @ sa)
            total[1:1 + d] += -2.0 * C * (xa.T @ (ya * sa))
            total[1 + d:] += (2.0 * C * (xa.T @ xa)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    sums = np.zeros(1 + d + d * d)
    for r in data.mapInArrow(part, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    return float(sums[0]), sums[1:1 + d], sums[1 + d:].reshape(d, d)


def _newton_direction(w: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """The minimum of the quadratic model plus the L1 norm, by coordinate descent."""
    step, down = np.zeros_like(w), np.zeros_like(w)  # down: hess @ step
    bend = np.maximum(np.diag(hess), 1e-12)
    for _ in range(INNER_SWEEPS):
        most = 0.0
        for j in range(len(w)):
            g = grad[j] + down[j]
            now = w[j] + step[j]
            new = now - g / bend[j]
            new = np.sign(new) * max(abs(new) - 1.0 / bend[j], 0.0)
            if new != now:
                down += hess[:, j] * (new - now)
                step[j] += new - now
                most = max(most, abs(new - now) * bend[j])
        if most < 1e-10:
            break
    return step


def l1_margin_weights(data: DataFrame, d: int, C: float, max_iter: int = 2000, tol: float = 1e-6) -> np.ndarray:
    """Weights (the last one the offset, penalised as the others) that minimise ``sum |w| + C sum max(0, 1 - y w.x)^2``.

    ``data`` has x (array of d values, the last one 1) and y (-1 / 1). A Newton step needs one pass over the rows; it is halved until it pays.
    The result meets the subgradient conditions within ``tol`` of the gradient at zero.
    """
    w = np.zeros(d)
    loss, grad, hess = _margin_sums(data, d, w, C)
    bar = tol * max(1.0, float(np.abs(grad).max(initial=0.0)))
    for _ in range(max_iter):
        if float(np.where(w != 0, np.abs(grad + np.sign(w)), np.maximum(np.abs(grad) - 1.0, 0.0)).max(initial=0.0)) <= bar:
            break
        step = _newton_direction(w, grad, hess)
        if not step.any():
            break
        gain = float(grad @ step + np.abs(w + step).sum() - np.abs(w).sum())
        size = 1.0
        for _ in range(HALVINGS):
            new = _margin_sums(data, d, w + size * step, C)
            if new[0] + np.abs(w + size * step).sum() <= loss + np.abs(w).sum() + 0.01 * size * gain:
                break
            size /= 2
        else:
            break
        w = w + size * step
        loss, grad, hess = new
    return w


def select_l1(df: DataFrame, cols: Sequence[str], label: str, C: float = 0.01, max_iter: int = 2000) -> list[str]:
    """Columns that keep a weight under the L1-penalised squared hinge loss; with more than two classes, each against the rest and the mean weight."""
    cols = list(cols)
    classes = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())
    ones = F.array(*(F.col(c).cast("double") for c in cols), F.lit(1.0))
    strength = []
    for value in classes[1:] if len(classes) == 2 else classes:
        data = df.where(F.col(label).isNotNull()).select(ones.alias("x"), F.when(F.col(label) == F.lit(value), 1.0).otherwise(-1.0).alias("y")).persist()
        try:
            strength.append(np.abs(l1_margin_weights(data, len(cols) + 1, C, max_iter)[:-1]))
        finally:
            data.unpersist()
    if not strength:
        return []
    weights = np.mean(strength, axis=0)
    return [c for c, w in zip(cols, weights) if w >= 1e-5]


#: Rows of a partition while a forest of 100 trees is fitted; beyond, rows are dealt out evenly.
FOREST_ROWS = 8_000


def forest_partitions(data: DataFrame, n: int, fewest: bool = False, n_trees: int = 100) -> DataFrame:
    """``n`` rows dealt to as many partitions as a forest needs; rows of one partition stay as they lie (``fewest``: in one). More than 100 trees count as more rows."""
    parts = -(-n * max(n_trees, 100) // (100 * FOREST_ROWS))
    if parts > 1:
        return data.repartition(parts)
    return data.coalesce(1) if fewest else data


def forest_settings(spark: SparkSession) -> dict:
    """Keep the node that each row has reached in each tree, so that a pass doesn't walk all trees from their roots; the trees are the same.

    What is kept is written to the checkpoint folder every few passes; without such a folder it isn't kept.
    """
    return {"cacheNodeIds": True} if shared_checkpoints(spark) else {}


def tree_importances(df: DataFrame, cols: Sequence[str], label: str, n_trees: int = 50, features: str = "sqrt", max_depth: int = 30, seed: int = 42) -> dict[str, float]:
    cols = list(cols)
    rows = assemble(df, cols).select(F.col(label).cast("double").alias("label"), "features").persist()
    data = None
    try:
        data = forest_partitions(rows, rows.count()).persist()
        model = RandomForestClassifier(
            numTrees=n_trees, featureSubsetStrategy=features, bootstrap=False, maxDepth=max_depth, seed=seed, **forest_settings(df.sparkSession)
        ).fit(data)
    finally:
        if data is not None:
            data.unpersist()
        rows.unpersist()
    return dict(zip(cols, model.featureImportances.toArray().tolist()))


def select_by_trees(df: DataFrame, cols: Sequence[str], label: str, **options) -> list[str]:
    """Columns at or above the mean importance."""
    scores = tree_importances(df, cols, label, **options)
    bar = sum(scores.values()) / max(len(scores), 1)
    return [c for c in cols if scores[c] >= bar]


def select_recursively(df: DataFrame, cols: Sequence[str], label: str, n_features: int = 10) -> list[str]:
    """Drop the column with the smallest weight, refit, repeat; the assembled table is cached once."""
    cols = list(cols)
    keep = list(range(len(cols)))
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    weighted = with_balanced_weight(assemble(df, cols, "all"), label, "weight", counts)
    data = weighted.select(F.col(label).cast("double").alias("label"), "weight", "all").persist()
    try:
        while len(keep) > min(n_features, len(cols)):
            sliced = VectorSlicer(inputCol="all", outputCol="features", indices=keep).transform(data)
            model = LogisticRegression(weightCol="weight", regParam=1.0 / max(n, 1), maxIter=1000, standardization=False).fit(sliced)
            strength = (model.coefficientMatrix.toArray() ** 2).sum(axis=0)
            keep.pop(int(strength.argmin()))
    finally:
        data.unpersist()
    return [cols[i] for i in keep]
