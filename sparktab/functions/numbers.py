"""Small numeric expressions shared by several operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def unit_scale(x: Column, low: float, high: float) -> Column:
    """Map [low, high] to [0, 1]; a constant range maps to 0."""
    if high is None or low is None or high - low < 1e-12:
        return F.when(x.isNotNull(), F.lit(0.0))
    return (x - F.lit(low)) / F.lit(high - low)


def clip(x: Column, low, high) -> Column:
    """Bound a value; a missing value or a missing bound changes nothing."""
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def lerp(u: Column, low, high) -> Column:
    return low + u * (high - low)


def log_lerp(u: Column, low, high) -> Column:
    return F.exp(F.ln(low) + u * (F.ln(high) - F.ln(low)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalize(a: Column) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    norm = F.sqrt(dot(a, a))
    safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return F.transform(a, lambda x: x.cast("double") / safe)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17; error below 7.5e-8."""
    # The published polynomial.
    coefficients = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = sum((c * F.pow(t, F.lit(i + 1.0)) for i, c in enumerate(coefficients)), F.lit(0.0))
    upper = normal_pdf(z) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def format_p_value(p: Column, scientific_below: float = 1e-4, inclusive: bool = True) -> Column:
    """Six decimals, or two significant decimals in scientific form for small values."""
    small = p <= scientific_below if inclusive else p < scientific_below
    return F.when(small, F.format_string("%.2e", p)).otherwise(F.format_string("%.6f", p))


def significance(p: Column, level: float = 0.05) -> Column:
    return F.when(p <= level, "Significant").otherwise("Not Significant")


def invert_map(m: Column) -> Column:
    return F.map_from_entries(
        F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value")))
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson correlation."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    a, b, x = (n - 2) / 2.0, 0.5, 1.0 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if r else 0.0
    if r == 0:
        return 1.0
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(DoubleType())
def pearson_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """One value per feature, so a handful of rows."""
    p = [correlation_p(a, b) for a, b in zip(r, n)]
    return pd.Series(p).replace({np.nan: None})
