"""Category codes, label codes and date expansion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import calendar_parts, days_between, parse_gregorian, parse_jalali
from .ordered import TARGET_ROWS, global_rank, hash_key, running_totals
from .schema import categorical_columns, date_columns

# Largest map that is written into the plan as literals; bigger maps are joined.
LITERAL_MAP_ROWS = 2_000


def category_map(df: DataFrame, cols: Sequence[str], row_id: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Table ``(column, category, code)``: codes follow the first row in which a category appears."""
    long = df.select(row_id, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in cols
    ])).alias("e")).select(row_id, "e.*").where(F.col("category").isNotNull())
    firsts = long.groupBy("column", "category").agg(F.min(row_id).alias("_first"))
    ranked = global_rank(firsts, "_first", "_r", by=["column"], ties=["category"], target_rows=target_rows)
    return ranked.select("column", "category", (F.col("_r") - 1).cast("int").alias("code"))


def encode_categories(
    df: DataFrame, mapping: DataFrame, cols: Sequence[str], unseen: str = "null", literal_rows: int = LITERAL_MAP_ROWS
) -> DataFrame:
    """Replace categories by their codes; ``unseen`` is ``null`` (scoring) or ``keep`` (training).

    A map of checked size becomes a literal lookup.  A larger one is joined,
    and rows whose category is missing skip the join so nulls cannot pile up
    on one task.
    """
    if unseen not in ("null", "keep"):
        raise ValueError(f"unknown rule for unseen categories: {unseen!r}")
    cols = [c for c in cols if c in df.columns]
    # Codes are dense from 0, so this reads at most ``literal_rows + 1`` rows per column and tells small maps from large ones.
    codes: dict[str, dict[str, int]] = {c: {} for c in cols}
    for r in mapping.where(F.col("column").isin(list(cols)) & (F.col("code") <= literal_rows)).collect():
        codes[r["column"]][r["category"]] = r["code"]
    small = [c for c in cols if len(codes[c]) <= literal_rows]

    def settle(code, c):
        value = code.cast("double")
        return value if unseen == "null" else F.coalesce(value, F.col(c).try_cast("double"))

    out = {}
    for c in small:
        if codes[c]:
            pairs = [F.lit(v) for kv in codes[c].items() for v in kv]
            code = F.try_element_at(F.create_map(*pairs), F.col(c).cast("string"))
        else:
            code = F.lit(None).cast("int")
        out[c] = settle(code, c)
    result = df.withColumns(out) if out else df
    for i, c in enumerate(c for c in cols if c not in small):
        table = mapping.where(F.col("column") == c).select(F.col("category").alias(f"_cat{i}"), F.col("code").alias(f"_code{i}"))
        known = result.where(F.col(c).isNotNull()).join(table, F.col(c).cast("string") == F.col(f"_cat{i}"), "left")
        known = known.withColumn(c, settle(F.col(f"_code{i}"), c)).drop(f"_cat{i}", f"_code{i}")
        missing = result.where(F.col(c).isNull()).withColumn(c, F.lit(None).cast("double"))
        result = known.unionByName(missing)
    return result


def label_codes(df: DataFrame, target: str) -> DataFrame:
    """Table ``(value, code)``: sorted distinct target values numbered from 0, one row per class."""
    distinct = df.select(F.col(target).alias("value")).where(F.col("value").isNotNull()).distinct()
    if dict(distinct.dtypes)["value"] == "string":
        # The first six bytes as a number follow the order of the text and deal the values to buckets.
        lead = F.conv(F.rpad(F.hex(F.substring(F.encode("value", "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
        ranked = global_rank(distinct.withColumn("_lead", lead), "_lead", "_r", ties=["value"])
        return ranked.select("value", (F.col("_r") - 1).cast("int").alias("code"))
    return global_rank(distinct, "value", "_r").select("value", (F.col("_r") - 1).cast("int").alias("code"))


def encode_label(df: DataFrame, codes: DataFrame, target: str, name: str = "label", literal_rows: int = LITERAL_MAP_ROWS) -> DataFrame:
    """Attach label codes: literals while the classes are few (counted first), a join beyond that."""
    if codes.limit(literal_rows + 1).count() > literal_rows:
        table = codes.select(F.col("value").alias("_value"), F.col("code").cast("double").alias(name))
        return df.join(table, F.col(target) == F.col("_value"), "left").drop("_value")
    code = F.lit(None).cast("int")
    for r in codes.collect():
        code = F.when(F.col(target) == F.lit(r["value"]), F.lit(r["code"])).otherwise(code)
    return df.withColumn(name, code.cast("double"))


def expand_dates(df: DataFrame, calendars: Mapping[str, str], reference: str | None = None) -> DataFrame:
    """Replace each date column by its calendar parts and, with a reference column, a difference in days.

    ``calendars`` maps a column to ``gregorian``, ``jalali`` or ``timestamp`` (already parsed).
    """
    readers = {"gregorian": parse_gregorian, "jalali": parse_jalali, "timestamp": lambda c: c.cast("timestamp")}
    # Parse once, then take the parts of the parsed column.
    names = {c: f"_ts_{i}" for i, c in enumerate(calendars)}
    parsed = df.withColumns({names[c]: readers[kind](F.col(c)) for c, kind in calendars.items()}) if calendars else df
    added = [p for c in calendars for p in calendar_parts(F.col(names[c]), c)]
    if reference:
        added += [days_between(F.col(names[reference]), F.col(names[c])).alias(f"{c}_time_diff") for c in calendars]
    return parsed.select(*[F.col(c) for c in df.columns if c not in calendars], *added)


def to_numeric(df: DataFrame, target: str, row_id: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Training-time conversion: expand dates, code categories; returns (frame, category map, date columns)."""
    calendars = date_columns(df, [c for c, t in df.dtypes if t == "string" and c != target])
    expanded = expand_dates(df, calendars)
    cols = [c for c in categorical_columns(expanded) if c != row_id]
    mapping = category_map(expanded, cols, row_id) if cols else None
    if mapping is None:
        empty = df.sparkSession.createDataFrame([], "column string, category string, code int")
        return expanded, empty, calendars
    return encode_categories(expanded, mapping, cols, unseen="keep"), mapping, calendars


def ordered_target_statistics(
    df: DataFrame, col: str, label: str, row_id: str, prior: float = 0.5, weight: float = 1.0, seed=42, name: str = "statistic", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Add the mean label of the rows of a category that stand before a row in digest order, drawn towards ``prior``.

    A row never sees its own label or a later one, so the value can be fitted on without leaking. Missing categories are a category. Rank and
    running total are cut into buckets, so a common category is spread over tasks.
    """
    ranked = global_rank(df.withColumn("_h", hash_key(seed, row_id)), "_h", "_r", by=[col], ties=[row_id], hashed=True, target_rows=target_rows).drop("_h")
    summed = running_totals(ranked, "_r", {"_upto": label}, by=[col], target_rows=target_rows)
    value = (F.col("_upto") - F.col(label) + F.lit(prior * weight)) / (F.col("_r") - 1 + F.lit(weight))
    return summed.withColumn(name, value).drop("_r", "_upto")
