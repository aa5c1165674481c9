"""Forests on MLlib: nodes kept between passes, rows dealt out."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from sparktab.operators import models, select
from sparktab.operators.metrics import regression_errors
from sparktab.operators.ordered import global_rank, hash_key
from sparktab.plans import surrogate

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    return spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(240)], f"row_id long, label int, {', '.join(f'{c} double' for c in NAMES)}").coalesce(1)


def test_kept_nodes_give_the_same_trees(rows):
    fitted = models.fit_model(rows, NAMES, "label", "rf", {"n_estimators": 6})
    assert fitted.model.getCacheNodeIds()
    counts = {float(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    data = models.with_balanced_weight(select.assemble(rows, NAMES, "_x").withColumn("_y", F.col("label").cast("double")), "_y", "_w", counts)
    plain = RandomForestClassifier(numTrees=6, maxDepth=30, minInstancesPerNode=1, featureSubsetStrategy="sqrt", seed=42, **models._outputs("_w")).fit(data.select("_x", "_y", "_w"))
    assert not plain.getCacheNodeIds() and fitted.model.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]
    held = plain.transform(data).select("row_id", F.round(vector_to_array("_p")[1], 9).alias("p"))
    assert {r["row_id"]: r["p"] for r in held.collect()} == {r["row_id"]: r["p"] for r in fitted.transform(rows).select("row_id", F.round(F.col("probability")[1], 9).alias("p")).collect()}


@pytest.fixture
def fitted_on(monkeypatch):
    """Partitions and rows that forests were fitted on."""
    seen, fit = [], RandomForestClassifier.fit

    def spy(self, data, *a):
        seen.append((data.rdd.getNumPartitions(), data.count(), self.getCacheNodeIds()))
        return fit(self, data, *a)

    monkeypatch.setattr(RandomForestClassifier, "fit", spy)
    monkeypatch.setattr(select, "FOREST_ROWS", 100, raising=False)
    return seen


def test_model_rows_are_dealt_out(rows, fitted_on):
    models.fit_model(rows, NAMES, "label", "rf", {"n_estimators": 3})
    models.fit_model(rows.limit(90), NAMES, "label", "rf", {"n_estimators": 3})
    assert fitted_on == [(3, 240, True), (1, 90, True)]


def test_selector_rows_are_dealt_out(rows, fitted_on):
    kept = select.select_by_trees(rows, NAMES, "label", n_trees=10)
    assert fitted_on == [(3, 240, True)] and "a" in kept and "c" not in kept


@pytest.fixture(scope="module")
def priced(spark):
    rng = np.random.default_rng(5)
    kind, size = rng.integers(0, 5, 150), rng.integers(0, 9, 150)
    table = [(i, [*(float(kind[i] == k) for k in range(5)), float(size[i])], float(3.0 * (kind[i] == 2) + size[i])) for i in range(150)]
    return spark.createDataFrame(table, "row_id long, x array<double>, y double").select("row_id", array_to_vector("x").alias("features"), "y").persist()


def test_regression_forest_keeps_nodes(priced):
    model = surrogate.regressors(5)["forest"]().fit(priced)
    plain = RandomForestRegressor(numTrees=5, maxDepth=30, minInstancesPerNode=2, seed=42, featuresCol="features", labelCol="y", predictionCol="yhat").fit(priced)
    assert model.getCacheNodeIds() and model.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]


def test_permuted_rows_that_stay_are_not_scored_again(priced, spark):
    """Same importances as with every row scored for every feature; rows scored are counted."""
    model, p, repeats = surrogate.regressors(5)["forest"]().fit(priced), 6, 4
    scored = []

    class Counted:
        def transform(self, df):
            scored.append(df)
            return model.transform(df)

    got = {r["feature"]: r for r in surrogate.permutation_importance(priced, Counted(), list("abcdef"), "row_id", repeats=repeats).collect()}
    assert sum(df.count() for df in scored) < 150 + 0.6 * 150 * p * repeats
    x = priced.select("row_id", "y", vector_to_array("features").alias("x"))
    own = {r["_r"]: r for r in global_rank(x.withColumn("_h", hash_key("42:base", "row_id")), "_h", "_r", ties=["row_id"], hashed=True).collect()}
    other = x.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_h", hash_key(42, "rep", "row_id"))
    z = {(r["rep"], r["_r"]): r["x"] for r in global_rank(other, "_h", "_r", by=["rep"], ties=["row_id"], hashed=True).collect()}
    every = [(k, j, r["y"], [*r["x"][:j], z[k, n][j], *r["x"][j + 1:]]) for k in range(repeats) for j in range(p) for n, r in own.items()]
    rows = spark.createDataFrame(every, "rep int, j int, y double, x array<double>").select("rep", "j", "y", array_to_vector("x").alias("features"))
    full = regression_errors(model.transform(priced)).first()["r2"]
    worse = {(r["rep"], r["j"]): full - r["r2"] for r in regression_errors(model.transform(rows), ["rep", "j"]).collect()}
    for j, name in enumerate("abcdef"):
        drops = [worse[k, j] for k in range(repeats)]
        assert got[name]["importance"] == pytest.approx(np.mean(drops), abs=1e-9) and got[name]["importance_std"] == pytest.approx(np.std(drops), abs=1e-9)
