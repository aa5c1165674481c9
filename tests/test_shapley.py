"""Exact tree Shapley values against enumeration of all sets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from sparktab.operators.boosting import BoostSpec
from sparktab.plans import shapley, surrogate


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(160, 8)), 1)
    y = x[:, 0] * x[:, 1] + 2 * (x[:, 2] > 0) - x[:, 3] + 0.1 * rng.normal(size=160)
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(160)]
    return x, spark.createDataFrame(rows, "row_id long, v array<double>, y double").select("row_id", array_to_vector("v").alias("features"), "y").persist()


def value(forest, root, row, known):
    """The mean of a tree where unknown features are followed on both sides."""
    def at(node):
        f = forest.feature[node]
        if f < 0:
            return forest.value[node]
        left, right = forest.left[node], forest.right[node]
        if f in known:
            return at(left if row[f] <= forest.cut[node] else right)
        return (forest.cover[left] * at(left) + forest.cover[right] * at(right)) / forest.cover[node]

    return at(root)


def enumerated(forest, row, p):
    share = 1 / len(forest.root) if forest.averaged else 1.0
    worth = {s: share * sum(value(forest, r, row, set(s)) for r in forest.root) for k in range(p + 1) for s in itertools.combinations(range(p), k)}
    out = []
    for j in range(p):
        rest = [f for f in range(p) if f != j]
        out.append(sum(
            math.factorial(k) * math.factorial(p - 1 - k) / math.factorial(p) * (worth[tuple(sorted((*s, j)))] - worth[s]) for k in range(p) for s in itertools.combinations(rest, k)))
    return np.array(out), worth[()] + forest.base


@pytest.fixture(scope="module", params=["forest", "boosted"])
def fitted(request, spark, table):
    _, df = table
    if request.param == "forest":
        model = surrogate.regressors(4, 3)["forest"]().fit(df)
        return model, surrogate.pack_forest(spark, model)
    model = surrogate.BoostedRegressor(BoostSpec(5, 0.3, "leaf", 0, 12, l2=0.5, loss="squared", start=None, min_rows=3)).fit(df)
    return model, surrogate.pack_boosted(model.booster)


def test_equal_to_enumeration_and_sums_to_the_prediction(table, fitted):
    x, df = table
    model, packed = fitted
    got = {r["row_id"]: r for r in shapley.tree_shapley(df, packed, ["row_id"]).collect()}
    assert len(got) == 160
    predicted = {r["row_id"]: r["yhat"] for r in model.transform(df).select("row_id", "yhat").collect()}
    for i, r in got.items():
        assert r["base"] + sum(r["phi"]) == pytest.approx(predicted[i], abs=1e-9)
    for i in (0, 17, 80):
        phi, base = enumerated(packed, x[i], 8)
        assert np.allclose(got[i]["phi"], phi, atol=1e-9) and got[i]["base"] == pytest.approx(base)


def test_ranking_and_small_tables(table, fitted):
    _, df = table
    _, packed = fitted
    names = [f"f{i}" for i in range(8)]
    rank = {r["feature"]: r["mean_abs_shap"] for r in shapley.shapley_ranking(df, packed, names, "row_id").collect()}
    assert set(rank) == set(names) and min(rank[f"f{i}"] for i in (0, 2, 3)) > max(rank[f"f{i}"] for i in (4, 5, 6, 7))
    assert shapley.tree_shapley(df.limit(0), packed, ["row_id"]).count() == 0
    twice = shapley.tree_shapley(df.limit(1).unionAll(df.limit(1)), packed, ["row_id"]).select("phi").distinct().count()
    assert twice == 1


def test_packed_forest_predicts_as_the_model(table, fitted):
    x, df = table
    model, packed = fitted
    each = packed.each(x)
    total = each.mean(axis=1) if packed.averaged else each.sum(axis=1) + packed.base
    predicted = [r["yhat"] for r in model.transform(df).orderBy("row_id").select("yhat").collect()]
    assert np.allclose(total, predicted)


def test_spread_of_a_packed_forest(table, spark):
    x, df = table
    model = surrogate.regressors(6, 3)["spread_forest"]().fit(df)
    got = surrogate.tree_spread(df, model, ["row_id"]).orderBy("row_id").collect()
    each = surrogate.pack_forest(spark, model).each(x)
    assert np.allclose([r["mu"] for r in got], each.mean(axis=1)) and np.allclose([r["sigma"] for r in got], each.std(axis=1))
