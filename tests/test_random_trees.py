"""Random trees: the same by passes and side by side, thresholds inside the node, one draw replayed by hand, missing values, ties."""

import json
import pickle
import sys

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sparktab.operators import boosting, random_trees, tree_files
from sparktab.operators.boosting import Run
from sparktab.plans import surrogate


def rows(spark, n=400, seed=3):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 1)
    x[::11, 1] = np.nan
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + 0.1 * x[:, 2]
    data = [(i, [None if np.isnan(v) else float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(data, "id long, x array<double>, y double")


def fit(df, spec, **kw):
    return random_trees.fit_random_trees(df, F.col("x"), F.col("y"), "id", [Run(spec)], **kw)[0]


def test_passes_and_partitions_give_the_same_trees(spark):
    _, _, df = rows(spark)
    spec = random_trees.random_spec(5, 6, 2)
    alone = repr(fit(df, spec).as_dict())
    assert repr(fit(df.repartition(7), spec).as_dict()) == alone
    assert repr(fit(df.repartition(5), spec, passes_only=True).as_dict()) == alone
    assert repr(fit(df.repartition(5), spec, part_cells=500).as_dict()) == alone


def test_nodes_in_small_portions_give_the_same_scores(spark, monkeypatch):
    x, _, df = rows(spark)
    spec = random_trees.random_spec(4, 8, 2)
    whole = fit(df, spec).margins(x)
    monkeypatch.setattr(random_trees, "OPEN_CELLS", 1)
    monkeypatch.setattr(random_trees, "PASS_CELLS", 1)
    assert np.allclose(fit(df, spec).margins(x), whole, atol=1e-9)


def test_nodes_hold_what_their_rows_say(spark):
    """Every inner node splits between the ends of its values at the drawn place, every leaf is the mean of its rows."""
    x, y, df = rows(spark)
    model = fit(df, random_trees.random_spec(6, 30, 2))
    edges = [np.unique(c[~np.isnan(c)]) for c in x.T]
    for number, tree in enumerate(model.trees):
        line = [(0, np.arange(len(x)), random_trees.root_key(42, number))]
        for node, own, key in line:
            assert tree.rows[node] == len(own)
            if tree.feature[node] < 0:
                assert tree.value[node] * len(model.trees) + model.start == pytest.approx(y[own].mean(), abs=1e-6)
                continue
            j = tree.feature[node]
            v = x[own, j]
            lo, hi = np.nanmin(v), np.nanmax(v)
            drawn = lo + random_trees.draws(np.array([key]), np.array([j]))[0, 0] * (hi - lo)
            assert lo <= tree.cut[node] < hi and tree.cut[node] == edges[j][edges[j] <= drawn].max()
            goes = np.where(np.isnan(v), tree.missing_left[node], v <= tree.cut[node])
            assert min(goes.sum(), (~goes).sum()) >= 2
            left, right = random_trees.child_keys(key)
            line += [(tree.left[node], own[goes], left), (tree.right[node], own[~goes], right)]
    assert np.mean((model.margins(x) - y) ** 2) < 0.05 * y.var()


def test_trees_differ_and_spread_is_theirs(spark):
    from pyspark.ml.functions import array_to_vector

    x, y, df = rows(spark)
    whole = df.select("id", "y", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))).alias("x")).withColumn("features", array_to_vector("x"))
    model = surrogate.regressors(7)["extra_trees"]().fit(whole)
    filled = np.nan_to_num(x)
    each = surrogate.pack_boosted(model.booster).each(filled)
    assert each.shape == (len(x), 7) and each.std(axis=1).max() > 0
    got = {r["id"]: (r["mu"], r["sigma"]) for r in surrogate.tree_spread(whole, model, ["id"]).collect()}
    assert np.allclose([got[i][0] for i in range(len(x))], each.mean(axis=1)) and np.allclose([got[i][1] for i in range(len(x))], each.std(axis=1))
    assert np.allclose(each.mean(axis=1), model.booster.margins(filled))


def test_constant_targets_and_equal_rows_are_leaves(spark):
    same = spark.createDataFrame([(i, [1.0, None], 5.0) for i in range(9)], "id long, x array<double>, y double")
    model = fit(same, random_trees.random_spec(2))
    assert all(t.feature == [-1] for t in model.trees) and np.allclose(model.margins(np.array([[1.0, np.nan], [7.0, 2.0]])), 5.0)


def test_folds_share_a_call_and_other_growth_is_refused(spark):
    _, _, df = rows(spark)
    spec = random_trees.random_spec(3, 5, 2)
    both = random_trees.fit_random_trees(df, F.col("x"), F.col("y"), "id", [Run(spec, (F.col("id") % 2 == k).cast("double")) for k in (0, 1)])
    for k, model in enumerate(both):
        alone = fit(df.where(F.col("id") % 2 == k), spec)
        assert model.trees[0].rows[0] == alone.trees[0].rows[0] == 200 and model.start == alone.start
    from sparktab.operators.boosting import BoostSpec

    with pytest.raises(ValueError):
        fit(df, BoostSpec())


def test_nodes_are_small():
    """A node takes about 80 bytes wherever trees gather, and a saved tree is the same."""
    tree = boosting.Tree()
    for i in range(20_000):
        tree.add(3, i / 7, 1.0 + i, 1000 + i)
    columns = [getattr(tree, name) for name in ("feature", "bin", "cut", "missing_left", "left", "right", "depth", "gain", "grad", "hess", "rows", "value")]
    apart = {id(v): sys.getsizeof(v) for c in columns if isinstance(c, list) for v in c}
    assert sum(map(sys.getsizeof, columns)) + sum(apart.values()) < 100 * 20_000
    model = boosting.Boosted(random_trees.random_spec(1), 0.0, [tree])
    again = boosting.Boosted.from_dict(json.loads(json.dumps(model.as_dict())))
    said = json.dumps(model.as_dict())
    assert json.dumps(again.as_dict()) == said == json.dumps(pickle.loads(pickle.dumps(model)).as_dict())


def test_folds_of_random_trees_are_fitted_one_after_another(spark, monkeypatch):
    """Never the trees of two folds in the driver, and the same predictions as from one fit of all folds."""
    _, _, df = rows(spark)
    df = df.select(F.col("id").alias("row_id"), array_to_vector(F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))).alias("features"), "y").persist()
    calls, fit = [], random_trees.fit_random_trees

    def counted(*a, **k):
        calls.append(len(a[4]))
        return fit(*a, **k)

    monkeypatch.setattr(surrogate, "fit_random_trees", counted)
    spec = random_trees.random_spec(3, 5, 2, 1)
    got = surrogate.cross_predict(df, {"extra_trees": lambda: surrogate.BoostedRegressor(spec, counted)}, "row_id", n_folds=3).persist()
    assert calls == [1, 1, 1] and got.count() == 400
    tagged = df.join(got.select("row_id", "fold"), "row_id").persist()
    models = fit(tagged, vector_to_array("features"), F.col("y"), "row_id", [Run(spec, (F.col("fold") != k).cast("double")) for k in range(3)], max_bins=256)
    for k, model in enumerate(models):
        want = {r["row_id"]: r["p"] for r in tagged.where(F.col("fold") == k).select("row_id", model.predict(vector_to_array("features")).alias("p")).collect()}
        assert {r["row_id"]: r["yhat"] for r in got.where(F.col("fold") == k).collect()} == want


@pytest.mark.parametrize("sum_cells", [4_000_000, 1])
def test_trees_in_files_are_the_same_and_stay_out_of_the_driver(spark, monkeypatch, sum_cells):
    """The same nodes and scores from trees that the driver never holds, missing values and rows without weight among them."""
    x, _, df = rows(spark)
    spec = random_trees.random_spec(5, 9, 2)
    run = Run(spec, (F.col("id") % 7 != 3).cast("double"))
    model = random_trees.fit_random_trees(df, F.col("x"), F.col("y"), "id", [run])[0]
    monkeypatch.setattr(tree_files, "FEW_GROWN", 0)
    monkeypatch.setattr(random_trees, "SUM_CELLS", sum_cells)
    monkeypatch.setattr(random_trees, "side_by_side", None)
    kept = random_trees.fit_random_trees(df.repartition(6), F.col("x"), F.col("y"), "id", [run], files=True)[0]
    trees = list(kept.trees())
    assert len(trees) == 5 and kept.start == model.start
    for a, b in zip(model.trees, trees):
        inner = np.array(a.feature) >= 0
        assert np.array_equal(a.feature, b.feature) and np.array_equal(np.array(a.bin)[inner], b.bin[inner]) and np.array_equal(np.array(a.left)[inner], b.left[inner])
        assert np.array_equal(np.array(a.missing_left)[inner], b.missing_left[inner]) and np.array_equal(a.value, b.value[:, 0]) and np.array_equal(a.hess, b.cover)
    said = {r["id"]: r["p"] for r in df.select("id", F.get(kept.scored(F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan"))))), F.lit(0)).alias("p")).collect()}
    assert [said[i] for i in range(len(x))] == model.margins(x).tolist()


def test_spread_of_trees_in_files(spark, monkeypatch):
    x, _, df = rows(spark)
    whole = df.select("id", "y", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))).alias("x")).withColumn("features", array_to_vector("x"))
    each = surrogate.pack_boosted(surrogate.regressors(7)["extra_trees"]().fit(whole).booster).each(np.nan_to_num(x))
    monkeypatch.setattr(tree_files, "FEW_GROWN", 0)
    model = surrogate.regressors(7)["extra_trees"]().fit(whole)
    assert isinstance(model.booster, tree_files.TreeFiles)
    got = {r["id"]: (r["mu"], r["sigma"]) for r in surrogate.tree_spread(whole, model, ["id"]).collect()}
    assert np.allclose([got[i][0] for i in range(len(x))], each.mean(axis=1)) and np.allclose([got[i][1] for i in range(len(x))], each.std(axis=1), atol=1e-9)
