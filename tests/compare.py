"""Run a registered query and its check SQL side by side."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "~null"
    if isinstance(v, float):
        if math.isnan(v):
            return "~nan"
        return repr(round(v, 5) + 0.0)
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, int):
        return repr(float(v)) if False else repr(v)
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rel.fetchall())


def compare(df, con, sql) -> str | None:
    """None when equal, else a short account of the difference."""
    a_cols, a = spark_rows(df)
    b_cols, b = duck_rows(con, sql)
    if a_cols != b_cols:
        return f"columns differ: {a_cols} vs {b_cols}"
    if len(a) != len(b):
        return f"row counts differ: {len(a)} vs {len(b)}; first spark {a[:2]} duck {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None
