"""Missing-value operators: fit is an aggregate, apply is a projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .neighbors import knn_join
from .ordered import TARGET_ROWS, global_rank, neighbours_in_order
from .quantiles import clean_numeric, group_quantiles, medians
from .stats import column_means


@dataclass
class ConstantFill:
    """One value per column; a column that was all missing at fit time stays missing."""

    values: Mapping[str, float | None]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: clean_numeric(F.col(c)) if v is None else F.coalesce(clean_numeric(F.col(c)), F.lit(v))
            for c, v in self.values.items() if c in df.columns
        })


def fit_mean(df: DataFrame, cols: Sequence[str]) -> ConstantFill:
    return ConstantFill(column_means(df, cols))


def fit_median(df: DataFrame, cols: Sequence[str]) -> ConstantFill:
    return ConstantFill(medians(df, cols))


@dataclass
class ClassFill:
    """Own-class value in training, overall value when scoring."""

    label: str
    overall: dict[str, float | None]
    per_class: list[tuple[object, dict[str, float | None]]]

    def transform(self, df: DataFrame) -> DataFrame:
        return ConstantFill(self.overall).transform(df)

    def transform_training(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, fallback in self.overall.items():
            own = F.lit(None).cast("double")
            for value, stats in self.per_class:
                own = F.when(F.col(self.label) == F.lit(value), F.lit(stats[c]).cast("double")).otherwise(own)
            out[c] = F.coalesce(clean_numeric(F.col(c)), own, F.lit(fallback).cast("double"))
        return df.withColumns(out)


def fit_class_mean(df: DataFrame, cols: Sequence[str], label: str) -> ClassFill:
    rows = df.groupBy(label).agg(*[F.avg(clean_numeric(F.col(c))).alias(c) for c in cols]).collect()
    return ClassFill(label, column_means(df, cols), [(r[label], {c: r[c] for c in cols}) for r in rows if r[label] is not None])


def fit_class_median(df: DataFrame, cols: Sequence[str], label: str) -> ClassFill:
    rows = group_quantiles(df, [label], {c: (c, 0.5) for c in cols}).collect()
    return ClassFill(label, medians(df, cols), [(r[label], {c: r[c] for c in cols}) for r in rows if r[label] is not None])


def forward_fill(df: DataFrame, order_col: str, cols: Sequence[str], by: Sequence[str] = (), target_rows: int = TARGET_ROWS) -> DataFrame:
    """Last value before, else next value after."""
    return _fill(df, order_col, cols, by, target_rows, ("_p_", "_n_"))


def backward_fill(df: DataFrame, order_col: str, cols: Sequence[str], by: Sequence[str] = (), target_rows: int = TARGET_ROWS) -> DataFrame:
    """Next value after, else last value before."""
    return _fill(df, order_col, cols, by, target_rows, ("_n_", "_p_"))


def _clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    floating = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns({c: clean_numeric(F.col(c)) for c in cols if c in floating})


def _fill(df, order_col, cols, by, target_rows, sides):
    near = neighbours_in_order(_clean(df, cols), order_col, cols, by, target_rows=target_rows)
    return near.select(*[
        F.coalesce(*[F.col(f"{s}{c}.v") for s in sides]).alias(c) if c in cols else F.col(c) for c in df.columns
    ])


def interpolate(df: DataFrame, order_col: str, cols: Sequence[str], by: Sequence[str] = (), target_rows: int = TARGET_ROWS) -> DataFrame:
    """Linear by row position; rows before the first or after the last value take that value."""
    placed = global_rank(_clean(df, cols), order_col, "_pos", by=by, target_rows=target_rows)
    near = neighbours_in_order(placed, "_pos", cols, by, target_rows=target_rows)

    def value(c):
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        between = p["v"] + (n["v"] - p["v"]) * (F.col("_pos") - p["at"]) / F.nullif(n["at"] - p["at"], F.lit(0))
        return F.coalesce(F.col(c).cast("double"), between, p["v"].cast("double"), n["v"].cast("double")).alias(c)

    return near.select(*[value(c) if c in cols else F.col(c) for c in df.columns])


@dataclass
class KnnFill:
    """Mean of the target column over the k nearest donor rows that know it; else the column mean."""

    donors: DataFrame
    cols: list[str]
    means: dict[str, float | None]
    k: int
    row_id: str
    block_rows: int

    def transform(self, df: DataFrame) -> DataFrame:
        out = _clean(df, self.cols)
        for c in self.cols:
            missing = df.where(clean_numeric(F.col(c)).isNull())
            known = self.donors.where(clean_numeric(F.col(c)).isNotNull())
            # The target is unknown in every query, so it adds nothing to a distance except the scale.
            near = knn_join(
                missing, known.withColumn("_y", F.col(c)).withColumn(c, F.lit(None).cast("double")),
                self.cols, self.k, self.row_id, self.row_id, exclude_self=False, block_rows=self.block_rows,
            )
            values = known.select(F.col(self.row_id).cast("long").alias("neighbor_id"), clean_numeric(F.col(c)).alias("_v"))
            filled = near.join(values, "neighbor_id").groupBy("query_id").agg(F.avg("_v").alias("_fill"))
            settled = out.where(F.col(c).isNotNull())
            unsettled = out.where(F.col(c).isNull()).join(filled, F.col(self.row_id).cast("long") == F.col("query_id"), "left")
            unsettled = unsettled.withColumn(c, F.coalesce("_fill", F.lit(self.means[c]).cast("double"))).drop("_fill", "query_id")
            out = settled.unionByName(unsettled.select(*settled.columns))
        return out.select(*df.columns)


def fit_knn(df: DataFrame, cols: Sequence[str], row_id: str, k: int = 5, block_rows: int = 1_024) -> KnnFill:
    return KnnFill(df.select(row_id, *cols), list(cols), column_means(df, cols), k, row_id, block_rows)


# ---- regression-based filling ----------------------------------------------------------------


def _matrix(pdf: pd.DataFrame, cols: Sequence[str]) -> np.ndarray:
    return pdf[list(cols)].to_numpy(dtype=float, na_value=np.nan)


def _sum_partials(df: DataFrame, cols: Sequence[str], partial, length: int) -> np.ndarray:
    """Add up one small vector per batch; rows stay on the executors."""

    def run(batches):
        total = np.zeros(length)
        for pdf in batches:
            total += partial(_matrix(pdf, cols))
        yield pd.DataFrame({"i": np.arange(length), "v": total})

    parts = df.select(*[clean_numeric(F.col(c)).alias(c) for c in cols]).mapInPandas(run, "i int, v double")
    out = np.zeros(length)
    for row in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[row["i"]] = row["v"]
    return out


def _augmented(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x])


def _centered(gram: np.ndarray, target: int):
    """Split a raw moment matrix (leading constant) in centred predictor moments, cross moments and means."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    others = [i for i in range(len(mean)) if i != target]
    return n, mean, cov[np.ix_(others, others)], cov[others, target], max(cov[target, target], 0.0), others


def least_squares(gram: np.ndarray, target: int) -> np.ndarray:
    """Intercept and coefficients (zero at the target) by the smallest-norm solution."""
    n, mean, xx, xy, _, others = _centered(gram, target)
    beta = np.zeros(len(mean) + 1)
    if others:
        w = np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ xy
        beta[1 + np.array(others)] = w
    beta[0] = mean[target] - beta[1:] @ mean
    return beta


def evidence_ridge(gram: np.ndarray, target: int, tol: float = 1e-3, max_iter: int = 300) -> np.ndarray:
    """Bayesian ridge: noise and weight precisions maximise the evidence, all from second moments."""
    n, mean, xx, xy, yy, others = _centered(gram, target)
    beta = np.zeros(len(mean) + 1)
    if others:
        eig, vec = np.linalg.eigh(xx)
        eig = np.maximum(eig, 0.0)
        proj = vec.T @ xy
        noise, weight, prior = 1.0 / (yy / n + np.finfo(float).eps), 1.0, 1e-6
        w = np.zeros(len(others))
        for step in range(max_iter):
            previous, w = w, vec @ (proj / (eig + weight / noise))
            residual = max(yy - 2 * w @ xy + w @ xx @ w, 0.0)
            if step and np.abs(previous - w).sum() < tol:
                break
            gamma = (noise * eig / (weight + noise * eig)).sum()
            weight = (gamma + 2 * prior) / (w @ w + 2 * prior)
            noise = (n - gamma + 2 * prior) / (residual + 2 * prior)
        w = vec @ (proj / (eig + weight / noise))
        beta[1 + np.array(others)] = w
    beta[0] = mean[target] - beta[1:] @ mean
    return beta


@dataclass
class RegressionFill:
    """Least-squares prediction per column from the others, in column order, so later columns see earlier fills."""

    means: dict[str, float | None]
    models: dict[str, tuple[float, dict[str, float]]]

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.means:
            if c not in self.models:
                df = df.withColumn(c, F.coalesce(clean_numeric(F.col(c)), F.lit(self.means[c]).cast("double")))
                continue
            intercept, weights = self.models[c]
            guess = F.lit(intercept)
            for other, weight in weights.items():
                guess = guess + F.lit(weight) * F.coalesce(clean_numeric(F.col(other)), F.lit(self.means[other]))
            df = df.withColumn(c, F.coalesce(clean_numeric(F.col(c)), guess))
        return df


def fit_regression(df: DataFrame, cols: Sequence[str]) -> RegressionFill:
    """One pass for means and spread, one pass for the moment matrices of all targets."""
    cols = list(cols)
    means = column_means(df, cols)
    spread = df.agg(*[(F.min(clean_numeric(F.col(c))) < F.max(clean_numeric(F.col(c)))).alias(c) for c in cols]).first()
    usable = [c for c in cols if means[c] is not None]
    if not usable:
        return RegressionFill(means, {})
    fill = np.array([means[c] for c in usable])
    p = len(usable)
    side = p + 1

    def partial(x):
        filled = _augmented(np.where(np.isnan(x), fill, x))
        return np.concatenate([(filled[~np.isnan(x[:, j])].T @ filled[~np.isnan(x[:, j])]).ravel() for j in range(p)])

    moments = _sum_partials(df, usable, partial, p * side * side).reshape(p, side, side)
    models = {}
    for j, c in enumerate(usable):
        if spread[c]:
            beta = least_squares(moments[j], j)
            models[c] = (float(beta[0]), {o: float(beta[1 + i]) for i, o in enumerate(usable) if o != c})
    return RegressionFill(means, models)


def _apply_steps(x: np.ndarray, fill: np.ndarray, steps: Sequence[tuple[int, np.ndarray]]) -> np.ndarray:
    out = np.where(np.isnan(x), fill, x)
    for j, beta in steps:
        rows = np.isnan(x[:, j])
        if rows.any():
            out[rows, j] = beta[0] + out[rows] @ beta[1:]
    return out


@dataclass
class ChainedFill:
    """Chained ridge regressions; the fitted steps are replayed batch by batch."""

    cols: list[str]
    fill: np.ndarray
    steps: list[tuple[int, np.ndarray]] = field(default_factory=list)
    rounds: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        cols, fill, steps = self.cols, self.fill, self.steps

        @F.pandas_udf(f"struct<{', '.join(f'`{c}`: double' for c in cols)}>")
        def replay(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_apply_steps(_matrix(frame, cols), fill, steps), columns=cols)

        packed = F.struct(*[clean_numeric(F.col(c)).alias(c) for c in cols])
        filled = df.withColumn("_filled", replay(packed))
        return filled.select(*[F.col(f"_filled.{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def fit_chained(df: DataFrame, cols: Sequence[str], max_rounds: int = 10, tol: float = 1e-3) -> ChainedFill:
    """Round-robin regressions from the column with fewest missing values to the one with most.

    Every step reads the base table once, replays the steps so far and adds up
    one moment matrix, so plans stay flat however many rounds run.
    """
    means = column_means(df, cols)
    cols = [c for c in cols if means[c] is not None]
    p, side = len(cols), len(cols) + 1
    base = df.select(*[clean_numeric(F.col(c)).alias(c) for c in cols]).persist()
    try:
        row = base.agg(
            *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(cols)],
            F.max(F.greatest(*[F.coalesce(F.abs(F.col(c)), F.lit(0.0)) for c in cols], F.lit(0.0))).alias("top"),
        ).first()
        missing = [row[f"m{i}"] for i in range(p)]
        order = sorted((i for i in range(p) if missing[i]), key=lambda i: (missing[i], i))
        state = ChainedFill(cols, np.array([means[c] for c in cols], dtype=float))
        if not order or p < 2:
            return state
        limit = tol * (row["top"] or 0.0)
        for _ in range(max_rounds):
            before = list(state.steps)
            for j in order:
                steps, fill = list(state.steps), state.fill

                def partial(x, j=j, steps=steps, fill=fill):
                    known = x[~np.isnan(x[:, j])]
                    filled = _augmented(_apply_steps(known, fill, steps))
                    return (filled.T @ filled).ravel()

                gram = _sum_partials(base, cols, partial, side * side).reshape(side, side)
                state.steps.append((j, evidence_ridge(gram, j)))
            state.rounds += 1
            if _largest_change(base, cols, state.fill, before, state.steps) < limit:
                break
        return state
    finally:
        base.unpersist()


def _largest_change(base, cols, fill, before, after) -> float:
    def run(batches):
        top = 0.0
        for pdf in batches:
            x = _matrix(pdf, cols)
            if len(x):
                top = max(top, float(np.abs(_apply_steps(x, fill, after) - _apply_steps(x, fill, before)).max()))
        yield pd.DataFrame({"d": [top]})

    return base.mapInPandas(run, "d double").agg(F.max("d")).first()[0] or 0.0
