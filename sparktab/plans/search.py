"""Candidate generation, cross-validated search, audit and leaderboard."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numbers import lerp, log_lerp
from ..operators.metrics import best_f_threshold, brier, confusion, curve_points, ranking_metrics, recall_at_specificity
from ..operators.ordered import global_rank, hash_key
from ..operators.quantiles import quantiles
from ..operators.split import stratified_folds
from ..operators.stats import top_messages
from .chain import ChainConfig, FittedStart, fit_chain, fit_start, start_key

# Shares of the candidate budget and the options of each preparation step.
QUOTAS = {"xgb": 0.30, "lgbm": 0.30, "rf": 0.10, "catboost": 0.10, "lr": 0.10, "stacker": 0.10}
IMPUTERS = ("mean", "class_mean", "interpolate", "knn:5", "iterative")
NORMALIZERS = ("zscore", "robust")
DETECTORS = ("iforest", "cluster", "statistical")
REMEDIATIONS = ("winsorize", "percentile_clip", "mad_replace", "cluster_local_median", "shrink", "none")
SELECTORS = ("kbest:10", "kbest:20", "kbest:30", "kbest:40", "trees")
BALANCERS = ("identity", "smote:3", "smote:5", "borderline_smote:3")

# One row per search dimension: name, kind, low, high, share of none, items.
DIMENSION_SCHEMA = "family string, name string, kind string, lo double, hi double, none_frac double, items array<string>"


def _dim(name, kind, lo=None, hi=None, none_frac=None, items=None):
    return (name, kind, None if lo is None else float(lo), None if hi is None else float(hi), none_frac, None if items is None else list(items))


def preparation_dimensions() -> list[tuple]:
    return [
        _dim("imputer", "cat", items=IMPUTERS), _dim("normalizer", "cat", items=NORMALIZERS),
        _dim("tamer__detector", "cat", items=DETECTORS), _dim("tamer__remediation", "cat", items=REMEDIATIONS),
        _dim("tamer__contamination", "log", 0.005, 0.15), _dim("tamer__mad_threshold", "lin", 2.0, 4.0),
        _dim("selector", "cat", items=SELECTORS), _dim("balancer", "cat", items=BALANCERS),
    ]


def family_dimensions(spw_base: float) -> dict[str, list[tuple]]:
    """Classifier dimensions per family; the positive-class weight range follows the class balance."""
    cap = min(10.0, 1.5 * spw_base)
    # Dimensions of each family with their scales and bounds.
    rate, trees = _dim("classifier__learning_rate", "log", 0.01, 0.3), _dim("classifier__n_estimators", "logint", 100, 1000)
    sampling = [_dim("classifier__subsample", "lin", 0.5, 1.0), _dim("classifier__colsample_bytree", "lin", 0.5, 1.0)]
    penalties = [
        _dim("classifier__reg_alpha", "log", 1e-3, 5.0), _dim("classifier__reg_lambda", "log", 0.1, 10.0), _dim("classifier__scale_pos_weight", "log", 1.0, cap),
    ]
    return {
        "xgb": [rate, _dim("classifier__max_depth", "int", 2, 12), trees, *sampling, _dim("classifier__min_child_weight", "logint", 1, 50), *penalties],
        "lgbm": [rate, _dim("classifier__num_leaves", "logint", 8, 128), trees, *sampling, _dim("classifier__min_child_samples", "logint", 5, 100), *penalties],
        "rf": [
            _dim("classifier__n_estimators", "logint", 100, 1000), _dim("classifier__max_depth", "mix_int_none", 2, 24, 0.10),
            _dim("classifier__min_samples_leaf", "logint", 1, 50), _dim("classifier__max_features", "cat", items=("sqrt", "log2", "0.5")),
        ],
        "catboost": [
            _dim("classifier__iterations", "logint", 100, 1000), _dim("classifier__learning_rate", "log", 0.01, 0.3),
            _dim("classifier__depth", "int", 2, 10), _dim("classifier__l2_leaf_reg", "log", 1.0, 10.0),
        ],
        "lr": [_dim("classifier__C", "log", 1e-3, 1e2), _dim("classifier__penalty", "cat", items=("l1", "l2"))],
        "stacker": [
            _dim("classifier__estimator__xgb__learning_rate", "log", 0.03, 0.1), _dim("classifier__estimator__xgb__max_depth", "int", 3, 6),
            _dim("classifier__estimator__xgb__scale_pos_weight", "log", max(1.0, spw_base / 2.0), min(10.0, spw_base)),
        ],
    }


def dimension_table(spark: SparkSession, spw_base: float, families: Sequence[str] | None = None) -> DataFrame:
    rows = []
    for family, dims in family_dimensions(spw_base).items():
        if families is None or family in families:
            rows += [(family, *d) for d in (*preparation_dimensions(), *dims)]
    return spark.createDataFrame(rows, DIMENSION_SCHEMA)


def latin_hypercube(points: DataFrame, dims: DataFrame, n: Column | int, seed, by: Sequence[str] = ("family",)) -> DataFrame:
    """One draw per stratum and dimension: adds ``stratum`` and ``u`` to every (point, dimension).

    ``points`` has ``i`` and the columns of ``by``; ``dims`` lists the few
    dimension names of each group.  The stratum is the rank of a digest, so it
    needs no generator state.
    """
    grid = points.join(dims.select(*by, "name"), list(by))
    keyed = grid.withColumn("_h", hash_key(seed, *by, "name", "i"))
    ranked = global_rank(keyed, "_h", "_r", by=[*by, "name"], ties=["i"], hashed=True)
    jitter = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("jitter"), "_h")), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    total = n if isinstance(n, Column) else F.lit(n)
    return ranked.select(
        *[c for c in grid.columns], (F.col("_r") - 1).alias("stratum"), ((F.col("_r") - 1 + jitter) / total).alias("u")
    )


def map_unit(u: Column, kind: Column, lo: Column, hi: Column, none_frac: Column, items: Column) -> tuple[Column, Column]:
    """(number, text) of a unit draw on a dimension; whole kinds give whole numbers and a none draw gives neither."""
    whole = lambda v: lo + F.least(F.floor(v * (hi - lo + 1)), hi - lo)
    mixed = F.when(u >= none_frac, whole((u - none_frac) / (1 - none_frac)))
    number = (
        F.when(kind == "lin", lerp(u, lo, hi)).when(kind == "log", log_lerp(u, lo, hi)).when(kind == "int", whole(u))
        .when(kind == "logint", F.bround(log_lerp(u, lo, hi), 0)).when(kind == "mix_int_none", mixed)
    )
    text = F.when(kind == "cat", F.get(items, F.least(F.floor(u * F.size(items)), F.size(items) - 1).cast("int")))
    return number.cast("double"), text


def family_counts(total: int, quotas: Mapping[str, float] = QUOTAS) -> dict[str, int]:
    """Candidates per family; the first family absorbs the rounding."""
    counts = {f: int(round(q * total)) for f, q in quotas.items()}
    first = next(iter(counts))
    counts[first] += total - sum(counts.values())
    return counts


def candidate_values(spark: SparkSession, spw_base: float, total: int = 200, quotas: Mapping[str, float] = QUOTAS, seed: int = 42,
                     dims: DataFrame | None = None) -> DataFrame:
    """``(family, i, name, kind, number, text)``: every candidate's value on every dimension."""
    dims = dimension_table(spark, spw_base, list(quotas)) if dims is None else dims
    counts = spark.createDataFrame(list(family_counts(total, quotas).items()), "family string, n long").where("n > 0")
    points = counts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    drawn = latin_hypercube(points, dims, F.col("n"), seed, by=["family"])
    joined = drawn.join(dims, ["family", "name"])
    number, text = map_unit(F.col("u"), F.col("kind"), F.col("lo"), F.col("hi"), F.col("none_frac"), F.col("items"))
    return joined.select("family", "i", "name", "kind", number.alias("number"), text.alias("text"))


def candidate_table(values: DataFrame) -> DataFrame:
    """One row per candidate: ``candidate``, ``family`` and one column per dimension, null where a family lacks it."""
    names = sorted((r["name"], r["kind"]) for r in values.select("name", "kind").distinct().collect())
    kinds: dict[str, str] = dict(names)
    wide = values.groupBy("family", "i").agg(*[
        F.max(F.when(F.col("name") == n, F.col("text" if k == "cat" else "number"))).alias(n) for n, k in kinds.items()
    ])
    return wide.withColumn("candidate", F.concat_ws("-", "family", F.lpad(F.col("i").cast("string"), 4, "0"))).drop("i")


def option_label(option: Column) -> Column:
    """Readable text of an option such as ``knn:5``; a missing option reads ``None``."""
    name, number = F.split(option, ":")[0], F.get(F.split(option, ":"), F.lit(1))
    key = F.when(name == "knn", "n_neighbors").when(name.contains("smote"), "k_neighbors").otherwise("k")
    return F.when(option.isNull(), "None").when(number.isNull(), name).otherwise(F.concat(name, F.lit("("), key, F.lit("="), number, F.lit(")")))


def family_of(name: Column) -> Column:
    """Family tag of a classifier name."""
    # Name parts and the tags they stand for.
    parts = {"XGBoost": "xgb", "LightGBM": "lgbm", "RandomForest": "rf", "CatBoost": "catboost", "LogisticRegression": "lr",
             "Calibrated": "stacker", "Stacking": "stacker"}
    out = F.lower(name)
    for part, tag in reversed(parts.items()):
        out = F.when(name.contains(part), tag).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def to_config(row: Mapping) -> ChainConfig:
    """Chain configuration of one candidate row."""
    whole = {"max_depth", "n_estimators", "min_child_weight", "num_leaves", "min_child_samples", "min_samples_leaf", "iterations", "depth"}
    params: dict = {}
    for key, value in row.items():
        if not key.startswith("classifier__") or value is None:
            continue
        name = key[len("classifier__"):]
        target = params
        if name.startswith("estimator__xgb__"):
            name, target = name[len("estimator__xgb__"):], params.setdefault("xgb", {"n_estimators": 300, "subsample": 0.9, "colsample_bytree": 0.9})
        target[name] = int(value) if name in whole else value
    return ChainConfig(
        row["imputer"], row["normalizer"], row["tamer__detector"], row["tamer__remediation"], float(row["tamer__contamination"]),
        float(row["tamer__mad_threshold"]), row["selector"], row["balancer"], row["family"], params,
    )


# ---- evaluation -------------------------------------------------------------------------------

#: Rows of a partition while a table is fitted again and again.
FIT_ROWS = 50_000
FOLD_SCHEMA = "candidate string, repeat int, fold int, pr_auc double, roc_auc double, fit_error string"


def _scores(df, features, label, row_id, config, fold_col, fold, seed, start: FittedStart | None = None):
    chain = fit_chain(df.where(F.col(fold_col) != fold), features, label, row_id, config, seed, start)
    held = df.where(F.col(fold_col) == fold)
    return chain.transform(held.select(row_id, label, *features)).select(
        row_id, F.col(label).cast("int").alias("label"), F.col("probability")[1].alias("score"))


def evaluate_fold(df, features, label, row_id, name, config, fold_col, fold, repeat=0, seed=42, start: FittedStart | Exception | None = None) -> tuple:
    """One fit and one metric row; an error of the fit is recorded whole, a mistake in the plan is raised.

    ``start``: the first steps where they were fitted before, or the error that they ended in.
    """
    try:
        if isinstance(start, Exception):
            raise start
        points = curve_points(_scores(df, features, label, row_id, config, fold_col, fold, seed, start))
        row = ranking_metrics(points).first()
        return (name, repeat, fold, row["pr_auc"], row["roc_auc"], None)
    except AnalysisException:
        raise
    except Exception as error:  # noqa: BLE001 - a failed candidate must not stop the sweep
        return (name, repeat, fold, None, None, f"{type(error).__name__}: {error}")


def _start(df, features, label, row_id, config, fold_col, fold, seed) -> FittedStart | Exception:
    try:
        return fit_start(df.where(F.col(fold_col) != fold), features, label, row_id, config, seed)
    except AnalysisException:
        raise
    except Exception as error:  # noqa: BLE001 - recorded for every candidate that needs it
        return error


def search(df: DataFrame, features: Sequence[str], label: str, row_id: str, configs: Mapping[str, ChainConfig], n_folds: int = 5,
           seed: int = 42, parallel: int = 8, starts: dict | None = None) -> DataFrame:
    """Fold metrics of every candidate.  Folds are dealt once; a bounded number of threads submit the fits.

    First steps that several candidates share are fitted once for a fold. ``starts`` keeps them for later calls on the same rows, folds and seed.
    """
    spark = df.sparkSession
    starts = {} if starts is None else starts
    tagged = stratified_folds(df.select(row_id, label, *features), label, row_id, n_folds, seed)
    tagged = tagged.coalesce(max(1, -(-df.count() // FIT_ROWS))).persist()  # a fit makes many passes over few rows
    try:
        work = [(name, config, fold) for name, config in configs.items() for fold in range(n_folds)]
        times = Counter(start_key(config) for config in configs.values())
        shared = {(start_key(c), fold): (c, fold) for _, c, fold in work if times[start_key(c)] > 1 and (start_key(c), fold) not in starts}
        with ThreadPoolExecutor(parallel) as pool:
            starts |= zip(shared, list(pool.map(lambda w: _start(tagged, list(features), label, row_id, w[0], "fold", w[1], seed), shared.values())))
            rows = list(pool.map(lambda w: evaluate_fold(tagged, list(features), label, row_id, w[0], w[1], "fold", w[2], 0, seed, starts.get((start_key(w[1]), w[2]))), work))
    finally:
        tagged.unpersist()
    return spark.createDataFrame(rows, FOLD_SCHEMA)


def summarize_folds(folds: DataFrame) -> DataFrame:
    """Mean, population deviation and range per candidate over the folds that worked."""
    return folds.groupBy("candidate").agg(
        F.avg("pr_auc").alias("mean_pr_auc"), F.stddev_pop("pr_auc").alias("std_pr_auc"),
        (F.max("pr_auc") - F.min("pr_auc")).alias("range_pr_auc"), F.avg("roc_auc").alias("mean_roc_auc"),
        F.stddev_pop("roc_auc").alias("std_roc_auc"), F.min("fit_error").alias("fit_error"),
    )


def audit(results: DataFrame) -> DataFrame:
    """Totals, failures and the spread of the mean score, one row."""
    q = quantiles(results, {"q": (F.col("mean_pr_auc"), [0.25, 0.5, 0.75])})["q"]
    x = F.col("mean_pr_auc")
    return results.agg(
        F.count(F.lit(1)).alias("n_total"), F.count(F.when(x.isNull(), 1)).alias("n_failed"), F.min(x).alias("min"),
        F.lit(q[0]).cast("double").alias("p25"), F.lit(q[1]).cast("double").alias("median"), F.lit(q[2]).cast("double").alias("p75"),
        F.max(x).alias("max"), F.stddev_samp(x).alias("std"), (F.max(x) - F.min(x)).alias("spread"),
    )


def failure_messages(results: DataFrame) -> DataFrame:
    return top_messages(results.where("mean_pr_auc is null"), "fit_error")


def leaderboard(results: DataFrame, top: int = 15, score: str = "mean_pr_auc") -> DataFrame:
    return results.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), "candidate").limit(top)


def operating_points(scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Hold-out report per group: areas, best F1 and F2 thresholds, recall at specificity 0.90, Brier score."""
    single = not by
    scored, by = (scored.withColumn("_all", F.lit(1)), ["_all"]) if single else (scored, list(by))
    points = curve_points(scored, by, label, score).persist()
    f1 = best_f_threshold(points, by, 1.0).select(*by, F.col("threshold").alias("f1_threshold"), F.col("f_score").alias("f1"),
                                                  F.col("precision").alias("f1_precision"), F.col("recall").alias("f1_recall"))
    f2 = best_f_threshold(points, by, 2.0).select(*by, F.col("threshold").alias("f2_threshold"), F.col("f_score").alias("f2"))
    spec = recall_at_specificity(points, by).select(*by, "recall_at_spec", F.col("threshold").alias("spec_threshold"))
    out = ranking_metrics(points, by)
    for part in (f1, f2, spec, brier(scored, by, label, score)):
        out = out.join(part, by)
    return out.drop("_all") if single else out


def winner_report(scored: DataFrame, label: str = "label", score: str = "score") -> dict[str, DataFrame]:
    """Operating points and confusion cells at 0.5 and at the best F1 threshold."""
    points = operating_points(scored, (), label, score)
    best = points.first()["f1_threshold"]
    return {"points": points, "default": confusion(scored, 0.5, (), label, score), "tuned": confusion(scored, best, (), label, score)}
