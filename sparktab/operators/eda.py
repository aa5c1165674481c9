"""Report numbers: histograms, class shares, correlations and their p-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import format_p_value, pearson_p_value, significance
from .metrics import guarded_corr
from .quantiles import clean_numeric

CORR_PER_PASS = 300


def histograms(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """``(column, bin, n, low, high)``: equal-width bins between each column's extremes, last bin closed.

    Extremes are literals, so counting is one partial aggregate per column and bin.  Empty bins are absent.
    """
    cols = list(cols)
    row = df.agg(*[F.min(clean_numeric(F.col(c))).alias(f"lo_{c}") for c in cols],
                 *[F.max(clean_numeric(F.col(c))).alias(f"hi_{c}") for c in cols]).first()
    spans = {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in cols if row[f"lo_{c}"] is not None}
    # A constant column gets a unit-wide range around its value.
    spans = {c: (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi) for c, (lo, hi) in spans.items()}

    def cell(c):
        lo, hi = spans[c]
        x = clean_numeric(F.col(c))
        # ``least`` skips nulls, so a missing value must be kept out first.
        place = F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1))).cast("int")
        return F.struct(F.lit(c).alias("column"), place.alias("bin"), F.lit(lo).alias("lo"), F.lit((hi - lo) / bins).alias("w"))

    cells = df.select(F.explode(F.array(*[cell(c) for c in spans])).alias("e")).select("e.*").where("bin is not null")
    counts = cells.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("w").alias("w"))
    return counts.select("column", "bin", "n", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"),
                         (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"))


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(left, right, r, n)`` of complete pairs; constant columns give a missing r.  A few hundred pairs per pass."""
    out = None
    for start in range(0, len(pairs), CORR_PER_PASS):
        some = pairs[start:start + CORR_PER_PASS]
        names = sorted({c for pair in some for c in pair})
        clean = df.select(*[clean_numeric(F.col(c)).alias(c) for c in names])
        fields = [F.struct(
            F.lit(a).alias("left"), F.lit(b).alias("right"), guarded_corr(a, b).alias("r"),
            F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"),
        ) for a, b in some]
        part = clean.agg(F.array(*fields).alias("a")).select(F.explode("a").alias("p")).select("p.*")
        out = part if out is None else out.unionByName(part)
    return out


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every ordered pair, the diagonal included."""
    cols = list(cols)
    upper = correlations(df, [(a, b) for i, a in enumerate(cols) for b in cols[i:]])
    lower = upper.where(F.col("left") != F.col("right")).select(
        F.col("right").alias("left"), F.col("left").alias("right"), "r", "n")
    return upper.unionByName(lower)


def p_values(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """``(feature, r, n, t_value, p_value, significance)`` of each feature against the target."""
    found = correlations(df, [(c, target) for c in cols])
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    scored = found.select(F.col("left").alias("feature"), "r", "n", t.alias("t_value"))
    scored = scored.withColumn("p_value", pearson_p_value(F.col("r"), F.col("n")))
    return scored.withColumn("significance", significance(F.col("p_value")))


def p_value_report(table: DataFrame) -> DataFrame:
    """Text lines in order: heading, one line per feature by rising p-value, summary."""
    line = F.format_string("%s: %s (%s)", F.col("feature"), format_p_value(F.col("p_value"), 1e-3, inclusive=False), F.col("significance"))
    body = table.select(F.lit(1).alias("part"), F.col("p_value").alias("sort_value"), F.col("feature").alias("sort_name"), line.alias("line"))
    spark = table.sparkSession
    head = spark.createDataFrame([(0, 0.0, "a", "P-VALUES ANALYSIS"), (0, 0.0, "b", "================")], body.schema)
    foot = table.agg(
        F.lit(2).alias("part"), F.lit(0.0).alias("sort_value"), F.lit("a").alias("sort_name"),
        F.format_string("Summary: %d/%d features are significant",
                        F.count(F.when(F.col("significance") == "Significant", 1)), F.count(F.lit(1))).alias("line"),
    )
    return head.unionByName(body).unionByName(foot).orderBy("part", "sort_value", "sort_name")
