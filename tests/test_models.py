"""Models, chain, bundle, stream and search."""

import random

import pytest
from pyspark.sql import functions as F

from sparktab.operators import metrics, models
from sparktab.plans import search, surrogate
from sparktab.plans.bundle import Bundle, RawPreprocessor, load_bundle, save_bundle
from sparktab.plans.chain import ChainConfig, fit_chain, run_balancer, run_selector, fit_imputer
from sparktab.operators.encode import category_map, encode_categories
from sparktab.streaming.scoring import score_stream, start_scoring

SMALL = {
    "lr": {"max_iter": 50}, "svc": {"n_components": 40, "max_iter": 20}, "rf": {"n_estimators": 10, "max_depth": 4}, "xgb": {"n_estimators": 5, "max_depth": 3},
    "lgbm": {"n_estimators": 5, "num_leaves": 8}, "catboost": {"iterations": 5, "depth": 3, "l2_leaf_reg": 3.0}, "mlp": {"hidden": (6,), "max_iter": 60},
    "stacker": {"xgb": {"n_estimators": 2, "max_depth": 2}, "lgbm": {"n_estimators": 2, "num_leaves": 4}, "lr": {"max_iter": 20}, "cv": 2, "inner_cv": 2},
}


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(1)
    rows = [(i, int(i % 4 == 0), rng.gauss(4 * (i % 4 == 0), 1), rng.gauss(0, 1)) for i in range(240)]
    return spark.createDataFrame(rows, "row_id long, label int, a double, b double").persist()


def auc(scored):
    points = metrics.curve_points(scored.withColumn("score", F.col("probability")[1]))
    return metrics.ranking_metrics(points).first()["roc_auc"]


@pytest.mark.parametrize("family", list(SMALL))
def test_family_separates_and_reloads(spark, separable, tmp_path, family):
    from sparktab.plans.bundle import _load_model, _save_model
    import json

    fitted = models.fit_model(separable, ["a", "b"], "label", family, SMALL[family])
    scored = fitted.transform(separable)
    assert auc(scored) > 0.95 and scored.columns[-1] == "probability"
    info = json.loads(json.dumps(_save_model(fitted, str(tmp_path / "m"))))
    again = _load_model(info, str(tmp_path / "m")).transform(separable)
    key = lambda df: sorted((r["row_id"], round(r["probability"][1], 9)) for r in df.collect())
    assert key(again) == key(scored)


def test_parameters_without_effect_are_recorded(separable):
    assert models.fit_model(separable, ["a"], "label", "lgbm", {**SMALL["lgbm"], "subsample": 0.5}).ignored == {"subsample": 0.5}
    assert models.fit_model(separable, ["a"], "label", "catboost", SMALL["catboost"]).ignored == {}
    with pytest.raises(ValueError):
        models.fit_model(separable, ["a"], "label", "other")


@pytest.fixture(scope="module")
def bundle(spark):
    rng = random.Random(8)
    rows = [(i, "yes" if i % 3 == 0 else "no", None if i % 11 == 0 else rng.gauss(3 * (i % 3 == 0), 1), ["u", "v", None][i % 3 if i % 7 else 0], f"2024-0{1 + i % 9}-1{i % 9}") for i in range(200)]
    raw = spark.createDataFrame(rows, "row_id long, target string, `m 1` double, kind string, seen string")
    clean = raw.withColumnRenamed("m 1", "m_1").withColumn("label", (F.col("target") == "yes").cast("int"))
    mapping = category_map(raw, ["kind"], "row_id")
    pre = RawPreprocessor("target", {"seen": "gregorian"}, mapping, ["m_1", "kind", "seen_month", "seen_is_weekend"], "simple")
    train = pre.transform(raw, ("row_id",)).join(clean.select("row_id", "label"), "row_id")
    chain = fit_chain(train, pre.features, "label", "row_id", ChainConfig("median", "zscore", "statistical", "shrink", selector="all", family="lr", params={"max_iter": 30}))
    return raw, Bundle(pre, chain, 0.4, {0: "no", 1: "yes"}, {"note": 1})


def labels(df):
    return sorted((r["row_id"], r["label"], round(r["confidence"], 9)) for r in df.select("row_id", "label", "confidence").collect())


def test_bundle_reload_gives_same_labels(spark, bundle, tmp_path):
    raw, b = bundle
    save_bundle(b, str(tmp_path / "b"))
    again = load_bundle(spark, str(tmp_path / "b"))
    assert labels(again.predict_labels(raw)) == labels(b.predict_labels(raw))
    assert again.threshold == 0.4 and again.metadata == {"note": 1} and dict(again.describe())["classifier"] == "lr"
    # A target column, extra columns and unseen categories do not disturb scoring.
    other = raw.drop("target").withColumn("extra", F.lit(1)).withColumn("kind", F.lit("new"))
    assert b.predict_labels(other).count() == 200


def test_stream_equals_batch(spark, bundle, tmp_path):
    raw, b = bundle
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    start_scoring(spark, b, raw.schema, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), kind="parquet").awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert labels(streamed) == labels(b.predict_labels(raw, batch_bounds=False))


def test_whole_table_steps_are_refused_on_streams(spark, bundle, tmp_path):
    raw, b = bundle
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        b.chain.tamer.transform(stream.select("row_id", F.col("m 1").alias("m_1")).withColumns({c: F.lit(0.0) for c in b.chain.tamer.state.cols if c != "m_1"}))
    held = b.chain.config.imputer
    b.chain.config.imputer = "knn:5"
    try:
        with pytest.raises(ValueError):
            score_stream(b, stream)
    finally:
        b.chain.config.imputer = held


def test_unknown_steps_are_refused(separable):
    for run in (lambda: run_selector(separable, ["a"], "label", "best"), lambda: run_balancer(separable, ["a"], "label", "row_id", "magic"),
                lambda: fit_imputer(separable, ["a"], "label", "row_id", "magic")):
        with pytest.raises(ValueError):
            run()


def test_search_records_failures_and_ranks(separable):
    configs = {
        "good": ChainConfig("mean", "zscore", "statistical", "none", selector="all", family="lr", params={"max_iter": 20}),
        "bad": ChainConfig("mean", "zscore", "statistical", "none", selector="all", family="lr", params={"C": -1.0}),
    }
    results = search.summarize_folds(search.search(separable, ["a", "b"], "label", "row_id", configs, 2)).persist()
    rows = {r["candidate"]: r for r in results.collect()}
    assert rows["good"]["mean_pr_auc"] > 0.9 and rows["bad"]["mean_pr_auc"] is None and rows["bad"]["fit_error"]
    assert [r["candidate"] for r in search.leaderboard(results).collect()] == ["good"]
    assert search.audit(results).first()["n_failed"] == 1


def test_candidates_fill_every_stratum(spark):
    values = search.candidate_values(spark, 3.0, 50).persist()
    assert search.family_counts(50) == {"xgb": 15, "lgbm": 15, "rf": 5, "catboost": 5, "lr": 5, "stacker": 5}
    # One draw per stratum: sorted draws of a linear dimension fall one in each interval.
    lin = sorted(r["number"] for r in values.where("family = 'xgb' and name = 'tamer__mad_threshold'").collect())
    assert all(2 + 2 * i / 15 <= v <= 2 + 2 * (i + 1) / 15 for i, v in enumerate(lin))
    table = search.candidate_table(values)
    assert table.count() == 50
    assert table.where("family = 'lr'").first()["classifier__learning_rate"] is None
    config = search.to_config(table.where("family = 'xgb'").first().asDict())
    assert config.family == "xgb" and isinstance(config.params["max_depth"], int) and config.imputer in search.IMPUTERS


def test_trust_region_stays_inside(spark):
    dims = search.dimension_table(spark, 4.0)
    best = {"family": "lr", "classifier__C": 1.0, "tamer__mad_threshold": 3.9, "imputer": "mean"}
    near = {r["name"]: r for r in surrogate.trust_region(dims, best).collect()}
    assert near["classifier__C"]["lo"] == pytest.approx(0.1, abs=1e-9) and near["classifier__C"]["hi"] == pytest.approx(10.0)
    assert (near["tamer__mad_threshold"]["lo"], near["tamer__mad_threshold"]["hi"]) == (pytest.approx(3.5), 4.0)
    assert near["imputer"]["lo"] is None and "classifier__depth" not in near


def test_importances_find_the_driver(spark):
    rng = random.Random(6)
    rows = []
    for i in range(200):
        a, b = rng.random(), rng.random()
        rows.append((i, a, b, 5 * a + 0.01 * b))
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y double")
    enc = surrogate.fit_encoder(df, [], ["a", "b"])
    ready = enc.transform(df).select("row_id", "features", "y")
    model = surrogate.regressors(5, 5)["forest"]().fit(ready)
    drop = {r["feature"]: r for r in surrogate.permutation_importance(ready, model, enc.names, "row_id", 2).collect()}
    shap = {r["feature"]: r["mean_abs_shap"] for r in surrogate.shapley_importance(ready, model, enc.names, "row_id", 2).collect()}
    assert drop["a"]["importance"] > 0.5 > drop["b"]["importance"] and shap["a"] > 10 * shap["b"]


def test_quota_repair(spark):
    rows = [(i, "big" if i < 30 else "rare", f"s{i % 2}", "b", float(100 - i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, family string, selector string, balancer string, acq double")
    out = surrogate.select_with_quotas(df, "acq", 8, {"family": 0.10, "selector": 0.05, "balancer": 0.05}, "id").collect()
    assert len(out) == 8 and sum(r["family"] == "rare" for r in out) == 1 and 0 in {r["id"] for r in out}


def test_models_are_registered_with_the_defaults(monkeypatch):
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    from sparktab.plans import search, surrogate
    from sparktab.queries import QUERIES, q_models

    fit, regress, compare, cross, ranking, optimize = (MagicMock() for _ in range(6))
    monkeypatch.setattr(q_models.models, "fit_model", fit)
    monkeypatch.setattr(q_models, "_scaled", MagicMock())
    monkeypatch.setattr(q_models, "documents", MagicMock())
    monkeypatch.setattr(q_models, "F", MagicMock())
    monkeypatch.setattr(q_models, "_regression", lambda spark, sf: (MagicMock(), MagicMock(), MagicMock()))
    for name, fake in (("regressors", regress), ("compare_regressors", compare), ("cross_predict", cross), ("pack_forest", MagicMock()), ("optimize", optimize)):
        monkeypatch.setattr(surrogate, name, fake)
    monkeypatch.setattr(q_models.shapley, "shapley_ranking", ranking)
    for name in ("permutation_importance", "tree_spread", "surface_grid", "meta_table"):
        monkeypatch.setattr(surrogate, name, MagicMock())
    for name in ("search", "candidate_table", "candidate_values"):
        monkeypatch.setattr(search, name, MagicMock())
    for key in ("m4_boosted_xgb", "m5_boosted_lgbm", "m6_boosted_catboost", "m8_calibrated_stack", "g3_compare_regressors", "g4_predicted_observed",
                "g5_permutation_importance", "g6_shapley_importance", "g7_surface_scores", "g13_next_batch"):
        QUERIES[key](SimpleNamespace(createDataFrame=MagicMock()), "")
    given = {c.args[3]: c.args[4] for c in fit.call_args_list}
    assert given == {"xgb": {"scale_pos_weight": 0.5}, "lgbm": {}, "catboost": {}, "stacker": {}}
    assert all(not c.args and not c.kwargs for c in regress.call_args_list)
    assert len(compare.call_args.args) == 2 and len(cross.call_args.args) == 3 and not ranking.call_args.kwargs
    assert not {"n_folds"} & set(compare.call_args.kwargs) and not optimize.call_args.kwargs
