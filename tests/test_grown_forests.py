"""Forests that grow next to their rows: what nodes hold, draws, files, and the models that use them."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from sparktab.operators import boosting, forests, models, tree_files
from sparktab.operators.boosting import Grid, mixed
from sparktab.plans import bundle, shapley, surrogate
from sparktab.session import scratch_path

from test_shapley import enumerated

SPEC = forests.ForestSpec(3, 30, 2, 2, 0, 7)


def made(n=300, seed=4):
    r = np.random.default_rng(seed)
    x = np.stack([r.integers(0, 6, n), r.integers(0, 20, n), r.integers(0, 2, n), np.round(r.normal(size=n), 2)], axis=1).astype(float)
    return x, np.round(np.where(x[:, 0] > 2, 3.0, -1.0) + x[:, 3] + 0.1 * x[:, 1], 3)


def binned(x):
    edges = [np.unique(c) for c in x.T]
    edges = [e if len(e) <= 32 else np.unique(np.quantile(e, np.linspace(0, 1, 33)[1:], method="lower")) for e in edges]
    grid = Grid(edges)
    return grid, grid.binned(x)


def keys(n):
    return mixed(np.arange(n, dtype=np.uint64) + np.uint64(1))


@pytest.mark.parametrize("search_cells", [4_000_000, 1])
def test_every_split_is_the_best_of_the_drawn_features(search_cells, monkeypatch):
    monkeypatch.setattr(forests, "SEARCH_CELLS", search_cells)
    x, y = made()
    grid, bins = binned(x)
    unit = 2.0**30
    tree = forests.grown(bins, grid.sizes, keys(len(x)), [np.rint(y * unit)], SPEC, 1)
    copies = forests.copy_counts(keys(len(x)), SPEC, 1)
    line = [(0, np.arange(len(x)), forests.root_key(SPEC.seed, 1))]
    for node, own, key in line:
        c = copies[own]
        assert tree.cover[node] == c.sum() and tree.value[node, 0] / tree.cover[node] / unit == pytest.approx((c * y[own]).sum() / c.sum())
        total = (c * (y[own] - (c * y[own]).sum() / c.sum()) ** 2).sum()
        asked, best = forests.drawn_features(np.array([key]), 4, 2)[0], 0.0
        for j in asked:
            for cut in range(bins[j].max()):
                go = bins[j, own] <= cut
                if min(c[go].sum(), c[~go].sum()) >= 2:
                    best = max(best, total - sum((c[s] * (y[own][s] - (c[s] * y[own][s]).sum() / c[s].sum()) ** 2).sum() for s in (go, ~go)))
        if tree.feature[node] < 0:
            assert best < 1e-6
            continue
        go = bins[tree.feature[node], own] <= tree.bin[node]
        assert tree.feature[node] in asked
        assert total - sum((c[s] * (y[own][s] - (c[s] * y[own][s]).sum() / c[s].sum()) ** 2).sum() for s in (go, ~go)) == pytest.approx(best, rel=1e-6)
        left, right = forests.child_keys(key)
        line += [(tree.left[node], own[go], left), (tree.left[node] + 1, own[~go], right)]
    assert len(line) == len(tree.feature) > 50


def test_copies_are_poisson_and_equal_rows_are_drawn_apart():
    same = forests.told_apart(np.full(5000, 77, np.uint64))
    assert len(np.unique(same)) == 5000
    copies = forests.copy_counts(same, SPEC, 0)
    assert copies.mean() == pytest.approx(1, abs=0.06) and copies.var() == pytest.approx(1, abs=0.12)
    assert not np.array_equal(copies, forests.copy_counts(same, SPEC, 1))


def test_leaves_of_one_vote_are_joined():
    x, y = made(400)
    grid, bins = binned(x)
    second = y + np.random.default_rng(1).normal(size=len(y)) > 1
    spec = forests.ForestSpec(1, 30, 1, 2, 2, 3)
    tree = forests.grown(bins, grid.sizes, keys(len(x)), [np.where(second, 0.0, 2.0), np.where(second, 3.0, 0.0)], spec, 0)
    inner = np.flatnonzero(tree.feature >= 0)
    vote, leaf = tree.value.argmax(axis=1), tree.feature < 0
    a = tree.left[inner]
    assert len(inner) and not (leaf[a] & leaf[a + 1] & (vote[a] == vote[a + 1])).any()
    assert np.allclose(tree.value[inner], tree.value[a] + tree.value[a + 1]) and np.allclose(tree.cover[inner], tree.cover[a] + tree.cover[a + 1])


@pytest.fixture(scope="module")
def rows(spark):
    x, y = made(600)
    return x, y, spark.createDataFrame([(i, [float(v) for v in a], float(b), int(b > 1)) for i, (a, b) in enumerate(zip(x, y))], "row_id long, x array<double>, y double, label int").select(
        "*", array_to_vector("x").alias("features")).persist()


@pytest.fixture
def here(monkeypatch):
    """All forests grow next to their rows; MLlib's may not be fitted."""
    def refused(*a, **k):
        raise AssertionError("fitted by passes of the driver")

    monkeypatch.setattr(tree_files, "FEW_GROWN", 0)
    monkeypatch.setattr(RandomForestRegressor, "fit", refused)
    monkeypatch.setattr(RandomForestClassifier, "fit", refused)


def test_partitions_make_no_difference_and_fit_is_that_of_mllib(rows, spark, here, monkeypatch):
    x, y, df = rows
    told = lambda d: {r["row_id"]: r["yhat"] for r in surrogate.regressors(40)["forest"]().fit(d).transform(df).select("row_id", "yhat").collect()}
    got = told(df.coalesce(1))
    again = told(df.repartition(7))
    assert all(again[k] == pytest.approx(v, abs=1e-9) for k, v in got.items())
    monkeypatch.undo()
    plain = RandomForestRegressor(numTrees=40, maxDepth=30, minInstancesPerNode=2, seed=42, featuresCol="features", labelCol="y", predictionCol="yhat").fit(df)
    want = {r["row_id"]: r["yhat"] for r in plain.transform(df).select("row_id", "yhat").collect()}
    err = lambda p: np.mean([(p[i] - y[i]) ** 2 for i in range(len(y))]) / y.var()
    assert err(got) < 1.3 * err(want) and err(want) < 1.3 * err(got)


def test_large_regression_forests_leave_the_driver(rows, spark, here):
    """Many rows and trees are not MLlib's; equal values from folds, importances and the spread of trees."""
    x, y, df = rows
    model = surrogate.regressors(6)["forest"]().fit(df)
    files = model.files
    grid = Grid(files.cuts)
    each = np.stack([v[:, 0] for v in files.leaves(grid.binned(x))], axis=1)
    got = {r["row_id"]: r for r in surrogate.tree_spread(df, model, ["row_id"]).collect()}
    assert np.allclose([got[i]["mu"] for i in range(len(x))], each.mean(axis=1)) and np.allclose([got[i]["sigma"] for i in range(len(x))], each.std(axis=1), atol=1e-9)
    assert surrogate.cross_predict(df.select("row_id", "features", "y"), {"forest": surrogate.regressors(4)["forest"]}, "row_id", 3).count() == len(x)
    drop = {r["feature"]: r["importance"] for r in surrogate.permutation_importance(df.select("row_id", "features", "y"), model, list("abcd"), "row_id", 3).collect()}
    assert drop["a"] > drop["c"]


def packed(files):
    """Trees in files as one packed forest, cuts in place of bins."""
    trees = list(files.trees())
    first = np.cumsum([0, *(len(t.feature) for t in trees[:-1])])
    cat = lambda f: np.concatenate([f(t, k) for t, k in zip(trees, first)])
    cut = lambda t, _: np.array([files.cuts[f][b] if f >= 0 else np.nan for f, b in zip(t.feature, t.bin)])
    return surrogate.PackedForest(
        cat(lambda t, _: t.feature), cat(cut), cat(lambda t, k: np.where(t.feature >= 0, t.left + k, 0)), cat(lambda t, k: np.where(t.feature >= 0, t.left + 1 + k, 0)),
        cat(lambda t, _: files.numbers(t)[:, 0]), first, cat(lambda t, _: t.cover))


@pytest.mark.parametrize("looked_up", [8, 1])
def test_shapley_values_of_trees_in_files(rows, spark, here, monkeypatch, looked_up):
    monkeypatch.setattr(shapley, "LOOKED_UP", looked_up)
    monkeypatch.setattr(shapley, "SHAPLEY_ROWS", 250)
    x, _, df = rows
    model = surrogate.regressors(5)["forest"]().fit(df)
    forest = packed(model.files)
    got = {r["row_id"]: r for r in shapley.tree_shapley(df, surrogate.pack_forest(spark, model), ["row_id"]).collect()}
    said = {r["row_id"]: r["yhat"] for r in model.transform(df).select("row_id", "yhat").collect()}
    assert len(got) == len(x)
    for i, r in got.items():
        assert r["base"] + sum(r["phi"]) == pytest.approx(said[i], abs=1e-9) == pytest.approx(forest.each(x[i:i + 1]).mean(), abs=1e-9)
    for i in (0, 99, 431):
        phi, base = enumerated(forest, x[i], 4)
        assert np.allclose(got[i]["phi"], phi, atol=1e-9) and got[i]["base"] == pytest.approx(base)
    assert shapley.tree_shapley(df.limit(0), model.files, ["row_id"]).count() == 0


def test_large_classifiers_leave_the_driver_and_are_saved(rows, spark, here):
    x, _, df = rows
    wide = df.select("row_id", "label", *(F.get("x", F.lit(k)).alias(c) for k, c in enumerate("abcd")))
    fitted = models.fit_model(wide, list("abcd"), "label", "rf", {"n_estimators": 20})
    scores = {r["row_id"]: (r["label"], r["p"]) for r in fitted.transform(wide).select("row_id", "label", F.col("probability")[1].alias("p")).collect()}
    assert np.mean([(p > 0.5) == y for y, p in scores.values()]) > 0.95
    path = scratch_path(spark, "model")
    again = bundle._load_model(bundle._save_model(fitted, path), path)
    assert {r["row_id"]: r["p"] for r in again.transform(wide).select("row_id", F.col("probability")[1].alias("p")).collect()} == pytest.approx({k: p for k, (_, p) in scores.items()}, abs=1e-12)
    with pytest.raises(Exception):
        fitted.transform(wide.withColumn("a", F.lit(None).cast("double"))).collect()


def test_features_tried_are_those_of_mllib():
    assert [forests.features_tried(s, 8, 500, 0) for s in ("auto", "all", "sqrt", "log2", "onethird", "0.4", "5")] == [3, 8, 3, 3, 3, 4, 5]
    assert forests.features_tried("auto", 8, 1, 0) == 8 and forests.features_tried("auto", 6, 100, 2) == 3


def test_compared_models_share_a_task_each_and_predict_once(rows, monkeypatch):
    """Boosters of two presets and five folds run side by side; scores read written predictions, not a plan of all models."""
    assert boosting.n_parts(16_000 * 48, boosting.PART_CELLS, 10) == 1
    _, _, df = rows
    seen, score = [], surrogate.score_regressors

    def spy(predictions):
        seen.append(predictions._jdf.queryExecution().executedPlan().toString())
        return score(predictions)

    monkeypatch.setattr(surrogate, "score_regressors", spy)
    presets = surrogate.regressors(3, 4)
    best, _ = surrogate.compare_regressors(df.select("row_id", "features", "y"), "row_id", {k: presets[k] for k in ("boosted", "extra_trees")}, 3)
    assert best in ("boosted", "extra_trees") and len(seen) == 1 and "EvalPython" not in seen[0] and "InMemory" not in seen[0]


def test_folds_of_the_stability_gate_lie_in_few_partitions(rows, monkeypatch):
    _, _, df = rows
    wide = df.select("row_id", "label", *(F.get("x", F.lit(k)).alias(c) for k, c in enumerate("abcd"))).repartition(9)
    parts = []

    def spied(tagged, *a):
        parts.append(tagged.rdd.getNumPartitions())
        return tagged.select("row_id", "label", F.lit(0.5).alias("score"))

    monkeypatch.setattr(surrogate, "_scores", spied)
    surrogate.stability_scores(wide, list("abcd"), "label", "row_id", {"one": None}, 2, 1)
    assert parts == [1, 1]
