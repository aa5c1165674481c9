"""Scalers: one aggregate to fit, one projection to apply."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .quantiles import clean_numeric, quantiles


@dataclass
class LinearScale:
    """``(x - center) / scale`` per column; ``scale`` is never zero."""

    center: dict[str, float]
    scale: dict[str, float]

    def expr(self, c: str) -> Column:
        center, scale = self.center.get(c), self.scale.get(c)
        if center is None:
            return F.col(c).cast("double")
        return (clean_numeric(F.col(c)) - F.lit(center)) / F.lit(scale)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expr(c) for c in self.center if c in df.columns})


def _safe(scale: float | None) -> float:
    return scale if scale is not None and abs(scale) > 10 * 2.220446049250313e-16 else 1.0


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> LinearScale:
    row = df.agg(*[F.min(clean_numeric(F.col(c))).alias(f"lo_{c}") for c in cols],
                 *[F.max(clean_numeric(F.col(c))).alias(f"hi_{c}") for c in cols]).first()
    center = {c: row[f"lo_{c}"] for c in cols}
    return LinearScale(center, {c: _safe(row[f"hi_{c}"] - row[f"lo_{c}"]) if center[c] is not None else 1.0 for c in cols})


def fit_zscore(df: DataFrame, cols: Sequence[str]) -> LinearScale:
    """Population deviation."""
    row = df.agg(*[F.avg(clean_numeric(F.col(c))).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(clean_numeric(F.col(c))).alias(f"s_{c}") for c in cols]).first()
    return LinearScale({c: row[f"m_{c}"] for c in cols}, {c: _safe(row[f"s_{c}"]) for c in cols})


def fit_robust(df: DataFrame, cols: Sequence[str]) -> LinearScale:
    """Median and interquartile range, exact."""
    found = quantiles(df, {c: (F.col(c), [0.25, 0.5, 0.75]) for c in cols})
    center = {c: found[c][1] for c in cols}
    scale = {c: _safe(found[c][2] - found[c][0]) if center[c] is not None else 1.0 for c in cols}
    return LinearScale(center, scale)


def yeo_johnson(x: Column, lam: float | Column) -> Column:
    """The power transform; the exponent is a number or a column."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    up, down = F.log1p(F.greatest(x, F.lit(0.0))), F.log1p(F.greatest(-x, F.lit(0.0)))
    power = lambda logged, e: F.when(F.abs(e) < 1e-12, logged).otherwise((F.exp(e * logged) - 1) / F.nullif(e, F.lit(0.0)))
    return F.when(x >= 0, power(up, lam)).when(x < 0, -power(down, 2 - lam))


@dataclass
class PowerScale:
    """Power transform per column, then a z-score."""

    exponents: dict[str, float]
    linear: LinearScale = field(default=None)

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, lam in self.exponents.items():
            if c in df.columns:
                moved = yeo_johnson(clean_numeric(F.col(c)), lam)
                out[c] = (moved - F.lit(self.linear.center[c])) / F.lit(self.linear.scale[c])
        return df.withColumns(out)


def power_loglik(df: DataFrame, grid: dict[str, Sequence[float]]) -> dict[tuple[str, float], float]:
    """Log-likelihood of every (column, exponent) in one pass over the table.

    Each cell meets its column's exponents and is added up before any shuffle,
    so only one row per (column, exponent) leaves a task.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("c"), clean_numeric(F.col(c)).alias("x"), F.array(*[F.lit(float(l)) for l in ls]).alias("ls"))
        for c, ls in grid.items()
    ])
    long = df.select(F.explode(cells).alias("e")).select("e.*").where("x is not null").select("c", "x", F.explode("ls").alias("lam"))
    rows = long.groupBy("c", "lam").agg(
        F.var_pop(yeo_johnson(F.col("x"), F.col("lam"))).alias("v"), F.count(F.lit(1)).alias("n"),
        F.sum(F.signum("x") * F.log1p(F.abs("x"))).alias("s"),
    ).collect()
    out = {(c, float(l)): float("-inf") for c, ls in grid.items() for l in ls}
    for r in rows:
        if r["v"] is not None and r["v"] > 1e-300 and math.isfinite(r["v"]):
            out[(r["c"], r["lam"])] = -r["n"] / 2.0 * math.log(r["v"]) + (r["lam"] - 1.0) * r["s"]
    return out


def fit_power(df: DataFrame, cols: Sequence[str], low: float = -4.0, high: float = 6.0, points: int = 21, rounds: int = 4) -> PowerScale:
    """Most likely exponent by refining a grid: each round is one pass over all columns and narrows tenfold."""
    span = {c: (low, high) for c in cols}
    best = {c: 1.0 for c in cols}
    for _ in range(rounds):
        grid = {c: [a + (b - a) * i / (points - 1) for i in range(points)] for c, (a, b) in span.items()}
        scored = power_loglik(df, grid)
        for c in cols:
            values = [(scored[(c, float(l))], l) for l in grid[c]]
            top = max(values)
            if top[0] == float("-inf"):
                continue
            best[c] = top[1]
            step = (span[c][1] - span[c][0]) / (points - 1)
            span[c] = (best[c] - step, best[c] + step)
    moved = df.select(*[yeo_johnson(clean_numeric(F.col(c)), best[c]).alias(c) for c in cols])
    return PowerScale(best, fit_zscore(moved, cols))


FITTERS = {"minmax": fit_minmax, "robust": fit_robust, "zscore": fit_zscore, "power": fit_power}
