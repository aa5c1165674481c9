"""Aggregates that feed the fitted operators and the reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .quantiles import MAX_BUFFERED_VALUES, clean_numeric, quantiles

MAD_TO_SIGMA = 1.4826  # Fixed value: consistency constant of the median absolute deviation.


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Rows and share per value."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return counts.withColumn("share", F.try_divide("n_rows", F.lit(float(total))))


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., column, value)`` with one row per cell."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), clean_numeric(F.col(c)).alias("value")) for c in cols
    ])).alias("e")).select(*keep, "e.column", "e.value")


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(clean_numeric(F.col(c))).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def safe_mad(raw: float | None) -> float:
    return raw * MAD_TO_SIGMA if raw else 1.0


def mad_scales(df: DataFrame, medians: Mapping[str, float], max_values: int = MAX_BUFFERED_VALUES) -> dict[str, float]:
    """Scaled median absolute deviation per column; zero becomes one."""
    known = {c: m for c, m in medians.items() if m is not None}
    found = quantiles(df, {c: (F.abs(clean_numeric(F.col(c)) - F.lit(m)), [0.5]) for c, m in known.items()}, max_values)
    return {c: safe_mad(found[c][0]) for c in known}


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles, maximum per column."""
    quartiles = quantiles(df, {c: (F.col(c), [0.25, 0.5, 0.75]) for c in cols})
    fields = []
    for c in cols:
        x = clean_numeric(F.col(c))
        q = [F.lit(v) for v in quartiles[c]]
        fields.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), q[0].alias("p25"), q[1].alias("median"), q[2].alias("p75"), F.max(x).alias("max"),
        ))
    return df.agg(F.array(*fields).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def fold_summary(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, population deviation and range over folds, skipping missing folds."""
    aggs = []
    for v in values:
        x = clean_numeric(F.col(v))
        aggs += [F.avg(x).alias(f"mean_{v}"), F.stddev_pop(x).alias(f"std_{v}"), (F.max(x) - F.min(x)).alias(f"range_{v}")]
    return df.groupBy(*by).agg(*aggs)


def normalized_entropy(df: DataFrame, cols: Sequence[str], low: float = 0.80) -> DataFrame:
    """Entropy over log of the category count per column (0 with one category) and a low flag."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("axis"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("e")).select("e.*").where(F.col("value").isNotNull())
    counts = long.groupBy("axis", "value").agg(F.count(F.lit(1)).alias("c"))
    # -sum(p ln p) written with sums only: ln(N) - sum(c ln c) / N.
    sums = counts.groupBy("axis").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("c") * F.ln("c")).alias("_clnc")
    )
    h = F.ln("n") - F.col("_clnc") / F.col("n")
    out = sums.select("axis", "n", "k", F.when(F.col("k") > 1, h / F.ln("k")).otherwise(F.lit(0.0)).alias("entropy"))
    return out.withColumn("is_low", F.col("entropy") < low)


def modal_value(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value; a tie takes the smallest."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.col("n_rows").desc(), F.col(col).asc()).limit(1)


def top_messages(df: DataFrame, col: str, length: int = 240, top: int = 5) -> DataFrame:
    """Most frequent messages after shortening each to ``length`` characters."""
    short = df.where(F.col(col).isNotNull()).select(F.substring(col, 1, length).alias("message"))
    return short.groupBy("message").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.col("n_rows").desc(), "message").limit(top)


def ordered_distinct(df: DataFrame, by: Sequence[str], value: str, position: str, name: str) -> DataFrame:
    """Distinct values of each group in first-seen order.

    Values are reduced to one row each before any array is built, so the
    array holds distinct values only.
    """
    firsts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(position).alias("_p"))
    packed = firsts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_p", value))).alias("_a"))
    return packed.select(*by, F.transform("_a", lambda s: s[value]).alias(name))
