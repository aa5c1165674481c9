"""Column profiles: types, counts, extremes, first values and value patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.text import normalize_text

# Patterns a sample must match in full.
PATTERNS = {"binary_numeric": r"^[01]$", "date_like": r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"}


def value_patterns(samples) -> F.Column:
    """Names of the patterns that every sample matches; no sample, no pattern."""
    checks = [
        F.when((F.size(samples) > 0) & F.forall(samples, lambda s: F.trim(s).rlike(p)), F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
        for n, p in PATTERNS.items()
    ]
    return F.concat(*checks)


def first_values(df: DataFrame, cols, row_id: str, n: int = 20) -> DataFrame:
    """``(column, samples)``: the first ``n`` non-null values in row order; partitions are cut to ``n`` before the shuffle."""
    long = df.select(row_id, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("e")).select(row_id, "e.*").where("value is not null")
    w = W.partitionBy("column").orderBy(row_id)
    kept = long.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    packed = kept.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("a"))
    return packed.select("column", F.transform("a", lambda s: s["value"]).alias("samples"))


def profile_columns(df: DataFrame, row_id: str, cols=None, sample_size: int = 20, approximate: bool = False) -> DataFrame:
    """One row per column."""
    cols = [c for c in (cols or df.columns) if c != row_id]
    fields = {f.name: f.dataType for f in df.schema.fields}
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    null = F.lit(None).cast("double")
    rows = []
    for c in cols:
        kind = fields[c]
        numeric = isinstance(kind, T.NumericType)
        x = F.col(c).cast("double")
        rows.append(F.struct(
            F.lit(c).alias("name"), F.lit(kind.simpleString()).alias("dtype"), F.lit(numeric).alias("numeric"),
            F.lit(isinstance(kind, T.BooleanType)).alias("boolean"),
            F.lit(isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))).alias("datetime"),
            F.count(c).alias("non_null"), distinct(c).alias("unique"), F.count(F.when(F.col(c).isNull(), 1)).alias("missing"),
            (F.min(x) if numeric else null).alias("min_value"), (F.max(x) if numeric else null).alias("max_value"),
        ))
    wide = df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("p")).select("p.*")
    samples = first_values(df, cols, row_id, sample_size)
    out = wide.join(samples, wide["name"] == samples["column"], "left").drop("column")
    out = out.withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    return out.withColumn("normalized_name", normalize_text(F.col("name"))).withColumn("patterns", value_patterns(F.col("samples")))


def names_only(names: DataFrame, name: str = "name") -> DataFrame:
    """Profiles for bare column names."""
    empty = F.array().cast("array<string>")
    return names.select(
        F.col(name).alias("name"), F.lit("unknown").alias("dtype"), F.lit(False).alias("numeric"), F.lit(False).alias("boolean"),
        F.lit(False).alias("datetime"), F.lit(0).cast("long").alias("non_null"), F.lit(0).cast("long").alias("unique"),
        F.lit(0).cast("long").alias("missing"), F.lit(None).cast("double").alias("min_value"), F.lit(None).cast("double").alias("max_value"),
        empty.alias("samples"), normalize_text(F.col(name)).alias("normalized_name"), empty.alias("patterns"),
    )
