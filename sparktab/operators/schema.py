"""Column-level operators: clean names, choose, align and drop columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.dates import parse_gregorian, calendar_type, parse_jalali
from ..functions.text import sanitize_column, sanitize_name
from .ordered import global_rank


def clean_names(names: Sequence[str], target: str | None = None, mode: str = "full") -> list[str]:
    """Clean each name, keep the target, and number repeats ``_1``, ``_2`` in order."""
    out, seen = [], {}
    for name in names:
        base = name if name == target else sanitize_name(name, mode)
        if mode == "simple":
            out.append(base)
            continue
        repeat = seen.get(base, -1) + 1
        seen[base] = repeat
        out.append(f"{base}_{repeat}" if repeat else base)
    return out


def sanitize_columns(df: DataFrame, target: str | None = None, mode: str = "full") -> DataFrame:
    """Rename columns only; no data is touched."""
    return df.toDF(*clean_names(df.columns, target, mode))


def sanitize_catalog(
    df: DataFrame, name: str, position: str, by: Sequence[str] = (), target: str | None = None, mode: str = "full"
) -> DataFrame:
    """The same rule over a table that lists column names, numbered per table (``by``) and clean name."""
    base = sanitize_column(F.col(name), mode)
    if target is not None:
        base = F.when(F.col(name) == target, F.col(name)).otherwise(base)
    df = df.withColumn("clean_name", base)
    if mode == "simple":
        return df
    ranked = global_rank(df, position, "_repeat", by=[*by, "clean_name"])
    repeat = F.col("_repeat") - 1
    numbered = F.when(repeat > 0, F.concat_ws("_", "clean_name", repeat.cast("string"))).otherwise(F.col("clean_name"))
    return ranked.withColumn("clean_name", numbered).drop("_repeat")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns by type; booleans count as numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def categorical_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def columns_with_many_values(df: DataFrame, cols: Sequence[str], more_than: int = 10) -> list[str]:
    """Columns holding more than ``more_than`` distinct non-null values."""
    return count_and_choose(df, cols, more_than)[0]


def count_and_choose(df: DataFrame, cols: Sequence[str], more_than: int = 10) -> tuple[list[str], dict[str, int], int]:
    """(columns with many values, non-null count per column, rows) from one pass.

    A sketch settles the clear cases; only columns near the limit are counted exactly.
    """
    cols = list(cols)
    if not cols:
        return [], {}, 0
    # NaN is missing; a null fails the test too and stays null.
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in cols}
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.approx_count_distinct(value[c], 0.02).alias(f"d_{c}") for c in cols],
        *[F.count(value[c]).alias(f"n_{c}") for c in cols],
    ).first()
    near = [c for c in cols if more_than / 2 <= row[f"d_{c}"] <= more_than * 2]
    exact = df.agg(*[F.count_distinct(value[c]).alias(c) for c in near]).first() if near else {}
    wide = [c for c in cols if (exact[c] if c in near else row[f"d_{c}"]) > more_than]
    return wide, {c: row[f"n_{c}"] for c in cols}, row["rows"]


def missing_shares(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of nulls per column, one pass."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_share")) for c in cols])).alias("s")
    ).select("s.*")


def drop_sparse_columns(df: DataFrame, max_missing: float = 0.10, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose share of nulls is above the limit."""
    shares = {r["column"]: r["missing_share"] for r in missing_shares(df).collect()}
    return df.select(*[c for c in df.columns if c in keep or (shares[c] or 0.0) <= max_missing])


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def drop_rows_with_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(cols) if cols else None)


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Training order, single precision; a missing column is null and extra columns go."""
    present = set(df.columns)
    return df.select(
        *keep,
        *[(F.col(c) if c in present else F.lit(None)).cast("float").alias(c) for c in features],
    )


def date_columns(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """String columns whose every non-null value is a date, with the calendar of their first value by scan.

    An all-null column is skipped.  The calendar comes from the smallest
    non-null text, which does not depend on row order: all values of a date
    column share one calendar.
    """
    cols = list(cols or string_columns(df))
    if not cols:
        return {}

    def counts(c):
        s = F.col(c)
        return F.struct(
            F.count(s).alias("n"),
            F.count(F.when(parse_gregorian(s).isNotNull() & (calendar_type(s) != "jalali"), 1)).alias("gregorian"),
            F.count(F.when((calendar_type(s) == "jalali") & parse_jalali(s).isNotNull(), 1)).alias("jalali"),
        ).alias(c)

    row = df.agg(*[counts(c) for c in cols]).first()
    found = {}
    for c in cols:
        n, g, j = row[c]
        if n and g == n:
            found[c] = "gregorian"
        elif n and j == n:
            found[c] = "jalali"
    return found
