"""Imputation, taming, scaling and selection on hand-made frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.operators import eda, impute, isolation, outlier, scale, select


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0 if i % 2 else 10, 1), rng.gauss(0 if i % 2 else 10, 1), i % 2) for i in range(400)]
    rows += [(1000 + i, 60.0 + i, -50.0, 0) for i in range(3)]
    return spark.createDataFrame(rows, "row_id long, x double, y double, label int").persist()


def test_population_deviation_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 7.0), (1.0, 7.0), (3.0, 7.0)], "a double, c double")
    z = scale.fit_zscore(df, ["a", "c"])
    assert z.scale["a"] == pytest.approx(0.9428, abs=1e-4) and z.scale["c"] == 1.0
    assert [r["c"] for r in scale.fit_minmax(df, ["c"]).transform(df).collect()] == [0.0] * 3
    assert scale.fit_robust(df, ["c"]).scale["c"] == 1.0


def test_power_transform_finds_the_exponent(spark):
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(0, 1, 3000)) - 1

    def loglik(lam):
        up, down = np.log1p(np.maximum(x, 0)), np.log1p(np.maximum(-x, 0))
        moved = np.where(x >= 0, np.expm1(lam * up) / lam, -np.expm1((2 - lam) * down) / (2 - lam))
        return -len(x) / 2 * np.log(moved.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    best = max(np.arange(-2.0005, 2, 0.001), key=loglik)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    fitted = scale.fit_power(df, ["x"])
    assert abs(fitted.exponents["x"] - best) < 0.002
    row = fitted.transform(df).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert row[0] == pytest.approx(0, abs=1e-6) and row[1] == pytest.approx(1, abs=1e-6)


def test_class_fill_uses_labels_only_in_training(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, None), (3, 1, 9.0), (4, 1, 11.0), (5, 1, None), (6, 2, None)], "row_id long, label int, x double")
    fill = impute.fit_class_mean(df, ["x"], "label")
    train = {r["row_id"]: r["x"] for r in fill.transform_training(df).collect()}
    serve = {r["row_id"]: r["x"] for r in fill.transform(df).collect()}
    assert (train[2], train[5], train[6]) == (1.0, 10.0, 7.0) and serve[2] == serve[5] == 7.0


def test_all_missing_column_stays_missing(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    rows = impute.fit_mean(df, ["a", "b"]).transform(df).collect()
    assert [tuple(r) for r in rows] == [(1.0, None), (1.0, None)]


def linear(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, b, 2 * a - 3 * b + 1 + rng.gauss(0, 0.01)))
    holes = [(i, a, b, None if i % 5 == 0 else c) for i, a, b, c in rows]
    return spark.createDataFrame(holes, "row_id long, a double, b double, c double"), rows


@pytest.mark.parametrize("fit", [impute.fit_regression, impute.fit_chained])
def test_regression_fills_recover_a_linear_rule(spark, fit):
    df, rows = linear(spark)
    got = {r["row_id"]: r["c"] for r in fit(df, ["a", "b", "c"]).transform(df).collect()}
    assert max(abs(got[i] - c) for i, _, _, c in rows) < 0.1


def test_later_columns_see_earlier_fills(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, None)], "a double, b double")
    row = impute.fit_regression(df, ["a", "b"]).transform(df).collect()[3]
    # a is predicted from the mean of b (4 -> 2), then b from that a.
    assert (row["a"], row["b"]) == (pytest.approx(2.0), pytest.approx(4.0))


@pytest.mark.parametrize("detector", outlier.DETECTORS)
@pytest.mark.parametrize("remediation", outlier.REMEDIATIONS)
def test_taming_keeps_shape(blobs, detector, remediation):
    df = blobs.select("row_id", "x", "y")
    out = outlier.OutlierTamer(detector, remediation, mad_threshold=2.0).fit(df, ["x", "y"]).transform(df)
    assert out.columns == df.columns and out.count() == df.count()
    wide, narrow = df.agg(F.min("x"), F.max("x")).first(), out.agg(F.min("x"), F.max("x")).first()
    assert narrow[0] >= wide[0] - 1e-9 and narrow[1] <= wide[1] + 1e-9


def test_unknown_options_are_refused():
    for args in (("other", "none"), ("iforest", "other")):
        with pytest.raises(ValueError):
            outlier.OutlierTamer(*args)


def test_clip_is_stable_and_few_values_pass_through(blobs):
    df = blobs.select("row_id", "x", "label")
    tamer = outlier.OutlierTamer("statistical", "percentile_clip").fit(df)
    assert tamer.state.cols == ["x"]
    once = tamer.transform(df)
    assert once.exceptAll(tamer.transform(once)).isEmpty()


def test_forest_ranks_far_points_first(blobs):
    forest = isolation.fit_isolation_forest(blobs, ["x", "y"], "row_id", 0.05)
    scored = forest.score(blobs).orderBy(F.col("score").desc()).limit(3).collect()
    assert {r["row_id"] for r in scored} == {1000, 1001, 1002} and all(r["flag"] == 1 for r in scored)
    flagged = forest.score(blobs).agg(F.avg("flag")).first()[0]
    assert 0.02 <= flagged <= 0.06
    assert float(isolation.average_path(256)) == pytest.approx(10.2448, abs=1e-3)
    assert len(forest.trees) == 100 and forest.sample_size == 256


def test_forest_does_not_depend_on_partitions(blobs):
    a = isolation.fit_isolation_forest(blobs.coalesce(1), ["x", "y"], "row_id", None, n_trees=5)
    b = isolation.fit_isolation_forest(blobs.repartition(7), ["x", "y"], "row_id", None, n_trees=5)
    assert all(np.array_equal(x, y) for x, y in zip(a.trees, b.trees))


def test_selectors_find_the_signal(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, (i % 2) * 2 + rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), (i % 2) * 1.5 + rng.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, label int, s double, n1 double, n2 double, t double")
    cols = ["n1", "s", "n2", "t"]
    assert select.select_k_best(df, cols, "label", 2) == ["s", "t"] and select.select_k_best(df, cols, "label", "all") == cols
    assert set(select.select_by_trees(df, cols, "label", n_trees=20, max_depth=5)) == {"s", "t"}
    assert select.select_recursively(df, cols, "label", 2) == ["s", "t"]
    assert set(select.select_l1(df, cols, "label", C=0.003, max_iter=100)) == {"s", "t"}


def test_histogram_covers_every_row(spark):
    df = spark.createDataFrame([(float(v), 3.0) for v in range(31)] + [(None, None)], "a double, c double")
    rows = eda.histograms(df, ["a", "c"]).collect()
    assert sum(r["n"] for r in rows if r["column"] == "a") == 31 and sum(r["n"] for r in rows if r["column"] == "c") == 31
    assert max(r["bin"] for r in rows) == 29
