"""The L1-penalised squared hinge machine: subgradient conditions by SQL over the rows, and a plain descent."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktab.operators import select


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(250, 5)) * [1, 3, 0.5, 1, 2]
    y = np.sign(x[:, 0] - 0.6 * x[:, 1] + 0.4 * rng.normal(size=250))
    full = np.column_stack([x, np.ones(250)])
    df = spark.createDataFrame([([float(v) for v in r], float(s)) for r, s in zip(full, y)], "x array<double>, y double").repartition(5).persist()
    return full, y, df


@pytest.mark.parametrize("C", [0.001, 0.01, 0.5, 20.0])
def test_subgradient_conditions(rows, C):
    x, y, df = rows
    w = select.l1_margin_weights(df, 6, C)
    con = duckdb.connect()
    con.register("points", pd.DataFrame({"x": list(x), "y": y}))
    con.register("weights", pd.DataFrame({"j": range(1, 7), "w": w}))
    worst = con.execute(f"""
        WITH m AS (SELECT row_number() OVER () AS i, x, y FROM points),
        s AS (SELECT i, any_value(y) AS y, any_value(x) AS x, greatest(0, 1 - any_value(y) * sum(x[j] * w)) AS slack FROM m, weights GROUP BY i),
        g AS (SELECT j, any_value(w) AS w, -2 * {C} * sum(y * slack * x[j]) AS g FROM s, weights GROUP BY j)
        SELECT max(CASE WHEN w > 0 THEN abs(g + 1) WHEN w < 0 THEN abs(g - 1) ELSE greatest(abs(g) - 1, 0) END) FROM g""").fetchone()[0]
    assert worst < 1e-3
    # plain coordinate steps on the same function don't find less
    value = lambda v: np.abs(v).sum() + C * (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    v, rate = np.zeros(6), 1.0 / (2 * C * np.linalg.norm(x, 2) ** 2)
    for _ in range(20_000):
        g = -2 * C * x.T @ (y * np.maximum(0, 1 - y * (x @ v)))
        v = v - rate * g
        v = np.sign(v) * np.maximum(np.abs(v) - rate, 0)
    assert value(w) <= value(v) + 1e-6


def test_selection_drops_what_does_not_help(spark, rows):
    x, y, _ = rows
    df = spark.createDataFrame([(int(s > 0), *(float(v) for v in r[:5])) for r, s in zip(x, y)], "label int, a double, b double, c double, d double, e double")
    assert select.select_l1(df, list("abcde"), "label", C=0.02) == ["a", "b"]
    assert select.select_l1(df, list("abcde"), "label", C=1e-6) == []
    three = df.withColumn("label", F.when(F.col("a") > 0.7, 2).otherwise(F.col("label")))
    assert {"a", "b"} <= set(select.select_l1(three, list("abcde"), "label", C=0.05))
