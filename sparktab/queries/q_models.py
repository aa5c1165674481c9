"""Models, selectors that need a model, search, surrogates, bundles, files and streams.

Rows are all labelled documents; numbers describe the whole text and every row takes
part.  Models run with the defaults of their family.
"""

from pyspark.sql import functions as F

from ..operators import models, select
from ..operators.split import stratified_holdout
from ..plans import search, shapley, surrogate
from ..plans.bundle import Bundle, RawPreprocessor, decide, load_bundle, save_bundle, scoring_report
from ..plans.chain import ChainConfig, fit_chain
from ..session import scratch_path
from ..sources import tables
from ..streaming.scoring import start_scoring
from .bases import ORDERS, SCORES, orders, query, round_all, scores, table, with_

FEATURES = ["n_chars", "n_words", "n_lines", "digit_share", "upper_share", "word_length"]


def documents(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    t = F.col("text")
    size = F.greatest(F.length(t), F.lit(1))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return d.select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("n_chars"), words.cast("double").alias("n_words"),
        F.size(F.split(t, "\n")).cast("double").alias("n_lines"), (F.length(F.regexp_replace(t, "[^0-9]", "")) / size).alias("digit_share"),
        (F.length(F.regexp_replace(t, r"[^\p{Lu}]", "")) / size).alias("upper_share"), F.when(words > 0, size / words).alias("word_length"), "lang")


def _scaled(spark, sf):
    from ..operators.impute import fit_mean
    from ..operators.scale import fit_zscore

    df = documents(spark, sf)
    df = fit_mean(df, FEATURES).transform(df)
    return fit_zscore(df, FEATURES).transform(df).select("row_id", "label", *FEATURES)


def _model_query(key, family, params):
    @query(key)
    def run(spark, sf):
        df = _scaled(spark, sf).persist()
        fitted = models.fit_model(df, FEATURES, "label", family, params)
        return fitted.transform(df).select("row_id", "label", F.round(F.col("probability")[1], 6).alias("score"))

    return run


_model_query("m1_logistic_l2", "lr", {})
_model_query("m1_logistic_l1", "lr", {"C": 0.1, "penalty": "l1"})
_model_query("m2_kernel_svm", "svc", {})
_model_query("m3_random_forest", "rf", {})
_model_query("m4_boosted_xgb", "xgb", {"scale_pos_weight": 0.5})
_model_query("m5_boosted_lgbm", "lgbm", {})
_model_query("m6_boosted_catboost", "catboost", {})
_model_query("m7_perceptron", "mlp", {})
_model_query("m8_calibrated_stack", "stacker", {})


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "column string")


@query("l2_select_l1")
def l2(spark, sf):
    return _names(spark, select.select_l1(_scaled(spark, sf), FEATURES, "label", C=0.5, max_iter=100))


@query("l3_select_by_trees")
def l3(spark, sf):
    return _names(spark, select.select_by_trees(_scaled(spark, sf), FEATURES, "label", n_trees=50))


@query("l4_select_recursively")
def l4(spark, sf):
    return _names(spark, select.select_recursively(_scaled(spark, sf), FEATURES, "label", 3))


# ---- chain, bundle, files, streams --------------------------------------------------------------


def _bundle(spark, sf):
    df = documents(spark, sf)
    from ..operators.encode import category_map, encode_categories

    mapping = category_map(df, ["lang"], "row_id")
    coded = encode_categories(df, mapping, ["lang"], "keep")
    features = [*FEATURES, "lang"]
    config = ChainConfig("median", "robust", "statistical", "winsorize", selector="kbest:5", family="lr", params={})
    chain = fit_chain(coded, features, "label", "row_id", config)
    return df, Bundle(RawPreprocessor("label", {}, mapping, features, "simple"), chain, 0.5, {0: "poor", 1: "good"})


@query("t8_fit_chain")
def t8(spark, sf):
    df, bundle = _bundle(spark, sf)
    return bundle.predict_labels(df).select("row_id", "label", F.round("score", 6).alias("score"), "prediction")


@query("t7_saved_bundle_scores")
def t7(spark, sf):
    df, bundle = _bundle(spark, sf)
    path = scratch_path(spark, "bundle")
    save_bundle(bundle, path)
    return load_bundle(spark, path).predict_labels(df).select("row_id", "label", "confidence")


@query("t5_threshold_decision", with_(SCORES) + """
SELECT row_id, (score >= 0.4)::INTEGER AS prediction, CASE WHEN score >= 0.4 THEN 'sick' ELSE '0' END AS label FROM sc""")
def t5(spark, sf):
    p = scores(spark, sf).select("row_id", F.array(1 - F.col("score"), F.col("score")).alias("probability"))
    return decide(p, 0.4, {1: "sick"}).select("row_id", "prediction", "label")


@query("t6_scoring_report", with_(SCORES) + """
SELECT row_id, CASE WHEN score >= 0.5 THEN '1' ELSE '0' END AS label, round(greatest(score, 1 - score), 4) AS confidence FROM sc""")
def t6(spark, sf):
    p = scores(spark, sf).select("row_id", F.array(1 - F.col("score"), F.col("score")).alias("probability"))
    return round_all(scoring_report(decide(p, 0.5, {}), "row_id"), 4)


@query("s1_delimited_round_trip", with_(ORDERS) + """
SELECT row_id, price, cust::BIGINT AS cust, prio FROM ord""")
def s1(spark, sf):
    path = scratch_path(spark, "orders") + ".csv"
    out = orders(spark, sf).select("row_id", F.coalesce(F.col("price").cast("string"), F.lit("NA")).alias("price"), F.col("cust").cast("long").alias("cust"), "prio")
    out.write.option("header", True).option("sep", ";").csv(path)
    return tables.read_any(spark, path)


@query("s2_workbook_round_trip", with_(ORDERS) + """
SELECT row_id, price, cust::BIGINT AS cust, prio FROM ord""")
def s2(spark, sf):
    path = scratch_path(spark, "orders") + ".xlsx"
    tables.write_table(orders(spark, sf).select("row_id", "price", F.col("cust").cast("long").alias("cust"), "prio"), path, "xlsx")
    return tables.read_any(spark, path)


@query("s5_table_sink", with_(ORDERS) + "SELECT row_id, status, price FROM ord")
def s5(spark, sf):
    path = scratch_path(spark, "sink")
    tables.write_table(orders(spark, sf).select("row_id", "status", "price", F.array("prio").alias("raw")), path, "csv", drop=("raw",))
    return tables.read_delimited(spark, path, ",")


@query("s6_json_sink", with_(ORDERS) + "SELECT row_id, prio, status FROM ord")
def s6(spark, sf):
    path = scratch_path(spark, "json")
    tables.write_table(orders(spark, sf).select("row_id", "prio", "status"), path, "json")
    return spark.read.schema("row_id long, prio string, status string").json(path)


@query("s7_report_lines", with_(ORDERS) + """
SELECT status || ': ' || printf('%.6f', avg(price) / 1000000) || ' (' || count(*) || ')' AS line FROM ord GROUP BY status""")
def s7(spark, sf):
    path = scratch_path(spark, "report")
    per = orders(spark, sf).groupBy("status").agg(F.avg("price").alias("p"), F.count(F.lit(1)).alias("n"))
    tables.write_lines(per.select("status", F.format_string("%s: %.6f (%d)", F.col("status"), F.col("p") / 1000000, F.col("n")).alias("line")), path, ["status"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("st1_stream_scores")
def st1(spark, sf):
    df, bundle = _bundle(spark, sf)
    root = scratch_path(spark, "stream")
    df.write.parquet(f"{root}/in")
    running = start_scoring(spark, bundle, df.schema, f"{root}/in", f"{root}/out", f"{root}/progress", kind="parquet")
    running.awaitTermination()
    return spark.read.parquet(f"{root}/out")


# ---- search and surrogate -----------------------------------------------------------------------


def _configs():
    return {
        "lr": ChainConfig("mean", "zscore", "statistical", "mad_replace", selector="kbest:4", family="lr", params={}),
        "tree": ChainConfig("median", "robust", "statistical", "winsorize", selector="all", family="rf", params={"n_estimators": 100}),
        "broken": ChainConfig("mean", "zscore", "statistical", "none", selector="kbest:4", family="lr", params={"C": -1.0}),
    }


@query("h6_search")
def h6(spark, sf):
    return search.search(documents(spark, sf).drop("lang"), FEATURES, "label", "row_id", _configs(), n_folds=5)


@query("g14_stability_gate")
def g14(spark, sf):
    configs = {k: v for k, v in _configs().items() if k != "broken"}
    return surrogate.stability_table(surrogate.stability_scores(documents(spark, sf).drop("lang"), FEATURES, "label", "row_id", configs, n_folds=5, n_repeats=3))


@query("h9_winner_report")
def h9(spark, sf):
    df = stratified_holdout(documents(spark, sf).drop("lang"), "label", "row_id").persist()
    chain, points = surrogate.freeze_winner(df.where("not is_holdout"), df.where("is_holdout"), FEATURES, "label", "row_id", _configs()["lr"])
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in points.items()], "name string, value double")


def _regression(spark, sf):
    """Predict a part's price from its size, key and type."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_type", F.col("p_size").cast("double").alias("size"),
                                        (F.col("p_partkey") % 1000).cast("double").alias("key"), F.col("p_retailprice").alias("y"))
    enc = surrogate.fit_encoder(p, ["p_type"], ["size", "key"])
    return p, enc, enc.transform(p).select("row_id", "features", "y")


@query("g3_compare_regressors")
def g3(spark, sf):
    _, _, df = _regression(spark, sf)
    return surrogate.compare_regressors(df, "row_id")[1]


@query("g4_predicted_observed")
def g4(spark, sf):
    _, _, df = _regression(spark, sf)
    return surrogate.cross_predict(df, {"forest": surrogate.regressors()["forest"]}, "row_id")


@query("g5_permutation_importance")
def g5(spark, sf):
    _, enc, df = _regression(spark, sf)
    return surrogate.permutation_importance(df, surrogate.regressors()["forest"]().fit(df), enc.names, "row_id", repeats=20)


@query("g6_shapley_importance")
def g6(spark, sf):
    _, enc, df = _regression(spark, sf)
    forest = surrogate.pack_forest(spark, surrogate.regressors()["forest"]().fit(df))
    return shapley.shapley_ranking(df, forest, enc.names, "row_id")


@query("g6_linear_shapley", """
SELECT 'size' AS feature, round(avg(abs(2.0 * (p_size - (SELECT avg(p_size) FROM part)))), 6) AS mean_abs_shap FROM part UNION ALL
SELECT 'price', round(avg(abs(0.5 * (p_retailprice - (SELECT avg(p_retailprice) FROM part)))), 6) FROM part""")
def g6l(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return round_all(surrogate.linear_shap(p, {"size": 2.0, "price": 0.5}))


@query("g7_surface_scores")
def g7(spark, sf):
    p, enc, df = _regression(spark, sf)
    forest = surrogate.regressors()["extra_trees"]().fit(df)
    grid = surrogate.surface_grid(p, "size", "key", ["p_type"], ["size", "key"])
    return surrogate.tree_spread(enc.transform(grid), forest, ["ia", "ib", "size", "key"])


@query("g13_next_batch")
def g13(spark, sf):
    dims = spark.createDataFrame([
        ("lr", *d) for d in (
            search._dim("imputer", "cat", items=("mean", "median")), search._dim("normalizer", "cat", items=search.NORMALIZERS),
            search._dim("tamer__detector", "cat", items=("statistical",)), search._dim("tamer__remediation", "cat", items=("winsorize", "none")),
            search._dim("tamer__contamination", "log", 0.005, 0.15), search._dim("tamer__mad_threshold", "lin", 2.0, 4.0),
            search._dim("selector", "cat", items=("kbest:4", "all")), search._dim("balancer", "cat", items=("identity",)),
            search._dim("classifier__C", "log", 1e-3, 1e2), search._dim("classifier__penalty", "cat", items=("l2",)),
        )], search.DIMENSION_SCHEMA)
    df = documents(spark, sf).drop("lang").persist()
    first = search.candidate_table(search.candidate_values(spark, 1.0, 3, {"lr": 1.0}, 7, dims)).persist()
    folds = search.search(df, FEATURES, "label", "row_id", {r["candidate"]: search.to_config(r.asDict()) for r in first.collect()}, 5)
    meta = surrogate.meta_table(folds, first).persist()
    cats = ["family", "imputer", "normalizer", "tamer__remediation", "selector"]
    nums = ["tamer__contamination", "tamer__mad_threshold", "classifier__C"]
    return surrogate.optimize(df, FEATURES, "label", "row_id", meta, cats, nums, dims, 1.0)
