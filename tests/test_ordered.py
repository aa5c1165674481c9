"""Ordered operators and quantiles give the same answer however the work is cut."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktab.operators import impute, metrics, ordered, quantiles, split


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    # One group holds most rows; one value holds a third of them.
    rows = [(i, "hot" if i % 10 else f"g{i % 7}", 5.0 if i % 3 == 0 else rng.random() * 100, None if rng.random() < 0.6 else rng.random()) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, x double, v double").repartition(6).persist(), rows


@pytest.mark.parametrize("target", [50, 700, 10**6])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_fills_and_rank_match_pandas(skewed, target, by):
    df, rows = skewed
    pdf = pd.DataFrame(rows, columns=["id", "g", "x", "v"]).sort_values("id")
    keyed = pdf.groupby("g")["v"] if by else None
    expect = {
        "f": keyed.transform(lambda s: s.ffill().bfill()) if by else pdf["v"].ffill().bfill(),
        "b": keyed.transform(lambda s: s.bfill().ffill()) if by else pdf["v"].bfill().ffill(),
        "i": keyed.transform(lambda s: s.interpolate(method="linear", limit_direction="both")) if by else pdf["v"].interpolate(method="linear", limit_direction="both"),
    }
    for name, fn in (("f", impute.forward_fill), ("b", impute.backward_fill), ("i", impute.interpolate)):
        got = fn(df, "id", ["v"], by, target_rows=target).select("id", "v").toPandas().sort_values("id")
        assert np.allclose(got["v"].to_numpy(dtype=float), expect[name].to_numpy(), equal_nan=True), name
    ranks = ordered.global_rank(df, "id", "r", by=by, target_rows=target).select("id", "r").toPandas().sort_values("id")
    want = pdf.groupby("g").cumcount() + 1 if by else pd.Series(range(1, 3001), index=pdf.index)
    assert (ranks["r"].to_numpy() == want.to_numpy()).all()


def test_running_totals_descending(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("s"), F.lit(1).alias("n"))
    got = {r["s"]: r["t"] for r in ordered.running_totals(df, "s", {"t": "n"}, descending=True, target_rows=90).collect()}
    assert got == {float(i): 1000 - i for i in range(1000)}


@pytest.mark.parametrize("limit", [5, 60, 10**6])
def test_quantiles_are_exact(skewed, limit):
    df, rows = skewed
    probs = [0.0, 0.01, 0.25, 0.3333, 0.5, 0.95, 1.0]
    got = quantiles.quantiles(df, {"x": (F.col("x"), probs), "v": (F.col("v"), probs), "c": (F.lit(2.0), [0.5])}, limit)
    x = [r[2] for r in rows]
    v = [r[3] for r in rows if r[3] is not None]
    assert np.allclose(got["x"], np.quantile(x, probs)) and np.allclose(got["v"], np.quantile(v, probs))
    assert got["c"] == [2.0]


@pytest.mark.parametrize("limit", [40, 10**6])
def test_group_quantiles_with_hot_group(skewed, limit):
    df, rows = skewed
    pdf = pd.DataFrame(rows, columns=["id", "g", "x", "v"])
    got = quantiles.group_quantiles(df, ["g"], {"m": ("x", 0.5), "q": ("v", 0.9)}, limit).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g").agg(m=("x", "median"), q=("v", lambda s: s.quantile(0.9))).sort_index()
    assert np.allclose(got["m"], want["m"]) and np.allclose(got["q"], want["q"])


def test_nan_is_missing_and_empty_is_none(spark):
    df = frame(spark, [(float("nan"),), (1.0,), (3.0,)], "x double")
    assert quantiles.medians(df, ["x"]) == {"x": 2.0}
    assert quantiles.medians(df.where("x > 100 and not isnan(x)"), ["x"]) == {"x": None}


def test_folds_do_not_depend_on_partitions(skewed):
    df, _ = skewed
    one = split.stratified_folds(df.coalesce(1), "g", "id", 5).select("id", "fold").collect()
    many = split.stratified_folds(df.repartition(13), "g", "id", 5, target_rows=100).select("id", "fold").collect()
    assert sorted(one) == sorted(many)
    sizes = split.stratified_folds(df, "g", "id", 5).groupBy("g").pivot("fold").count().toPandas().set_index("g").fillna(0)
    assert ((sizes.max(axis=1) - sizes.min(axis=1)) <= 1).all()


def test_curves_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (1, 0.1)]
    points = metrics.curve_points(frame(spark, rows, "label int, score double"), target_rows=1)
    areas = metrics.ranking_metrics(points).first()
    assert areas["roc_auc"] == pytest.approx(0.5) and areas["pr_auc"] == pytest.approx(0.5)
    # All thresholds reach precision 0.5; the best F1 is at the lowest one.
    assert metrics.best_f_threshold(points).first()["threshold"] == 0.1
    spec = metrics.recall_at_specificity(points).first()
    assert spec["recall_at_spec"] == 0.0 and spec["threshold"] is None


def test_step_precision_is_not_the_trapezoid(spark):
    points = metrics.curve_points(frame(spark, [(1, 0.9), (0, 0.8), (1, 0.7)], "label int, score double"))
    assert metrics.ranking_metrics(points).first()["pr_auc"] == pytest.approx(0.8333, abs=1e-4)


def test_single_class_and_report_without_hits(spark):
    df = frame(spark, [(0, 0.2), (0, 0.3)], "label int, score double")
    assert metrics.ranking_metrics(metrics.curve_points(df)).first()["roc_auc"] is None
    report = {r["class"]: r for r in metrics.classification_report(metrics.confusion(df, 0.9)).collect()}
    assert report["1"]["f1"] == 0.0 and report["0"]["recall"] == 1.0 and report["1"]["support"] == 0


def test_constant_side_has_no_correlation(spark):
    df = frame(spark, [(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(metrics.guarded_corr("a", "b")).first()[0] is None
    assert metrics.spearman(df, y="a", yhat="b").first()["spearman"] == 0.0
