"""Delimited files and workbooks as frames with inferred types, and result writers."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import workbook

# Texts read as missing.
NULL_TOKENS = (
    " ", "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
SEPARATORS = (",", ";", "\t", "|")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that splits the first line most often."""
    first = spark.read.text(path).limit(1).first()
    line = first[0] if first else ""
    return max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))


def blank_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    return df.select(*[
        F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes
    ])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast each string column to bigint, double or boolean when every non-null value converts; one scan."""
    cols = [c for c, t in df.dtypes if t == "string"]
    if not cols:
        return df
    kinds = ("bigint", "double", "boolean")
    quoted = {c: F.trim(F.col(f"`{c}`")) for c in cols}
    row = df.agg(
        *[F.count(quoted[c]).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.count(quoted[c].try_cast(k)).alias(f"{k}{i}") for i, c in enumerate(cols) for k in kinds],
    ).first()
    types = {}
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        types[c] = next((k for k in kinds if n and row[f"{k}{i}"] == n), "string")
    return df.select(*[
        quoted[c].cast(types[c]).alias(c) if types.get(c, "string") != "string" else F.col(f"`{c}`") for c in df.columns
    ])


def read_delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Header line, sniffed separator, null tokens, inferred types."""
    sep = separator or sniff_separator(spark, path)
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    return infer_types(blank_tokens(raw))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Choose the reader by file name."""
    if "csv" in path:
        return read_delimited(spark, path)
    if "xlsx" in path:
        return read_workbooks(spark, path)
    raise ValueError(f"file format not supported: {path}")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """First sheets of one or many workbooks, in ranges of their unpacked bytes (:mod:`workbook`).

    Every file is read by its own heading, so columns may stand in another order; files that name other columns are refused.
    """
    workbook.register(spark)
    files = spark.read.format("binaryFile").load(path).select("path")  # names alone, no content

    def names_of(batches):
        for pdf in batches:
            heads = [(p, workbook.heading(p)) for p in pdf["path"]]
            yield pd.DataFrame([(p, h[0]) for p, h in heads if h is not None], columns=["path", "names"])

    headings = files.mapInPandas(names_of, "path string, names array<string>").persist()
    try:
        first = headings.orderBy("path").limit(1).first()
        if first is None:
            raise ValueError(f"no rows in {path}")
        other = headings.where(F.array_sort("names") != F.array_sort(F.array(*map(F.lit, first["names"])))).select("path").limit(1).first()
        if other is not None:
            raise ValueError(f"{other['path']} has other columns than {first['path']}")
        paths = [r["path"] for r in headings.select("path").collect()]  # a list of files, as every reader plans with
    finally:
        headings.unpersist()
    schema = StructType([StructField(n, StringType()) for n in first["names"]])
    body = spark.read.format("workbook").schema(schema).option("paths", json.dumps(sorted(paths))).load()
    return infer_types(blank_tokens(body))


def write_table(df: DataFrame, path: str, kind: str = "csv", drop: Sequence[str] = ()) -> None:
    """Result table without its non-portable columns; files are written by all tasks."""
    out = df.drop(*drop)
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in out.dtypes]
        out.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        out.write.mode("overwrite").json(path)
    elif kind == "xlsx":
        workbook.register(df.sparkSession)
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in out.dtypes]
        out.select(*flat).write.format("workbook").mode("overwrite").save(path)
    elif kind == "parquet":
        out.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown kind: {kind!r}")


def write_lines(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Ordered text report; sorted by ranges, so part files follow the order."""
    df.orderBy(*order).select("line").write.mode("overwrite").text(path)
