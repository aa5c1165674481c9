"""Learning from past candidates: meta-table, regressors, importances, response surface, next batches, stability."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import normal_cdf, normal_pdf
from ..operators.boosting import Boosted, BoostSpec, Run, fit_boosters
from ..operators.forests import ForestSpec, features_tried, fit_forest
from ..operators.metrics import regression_errors, spearman
from ..operators.ordered import global_rank, hash_key
from ..operators.quantiles import medians
from ..operators.random_trees import fit_random_trees, random_spec
from ..operators.select import forest_partitions, forest_settings
from ..operators.split import repeated_folds
from ..operators.stats import modal_value
from ..operators.tree_files import TreeFiles, grows_here
from ..session import cut_lineage, scratch_path
from .chain import ChainConfig, fit_chain
from .search import DIMENSION_SCHEMA, _scores, candidate_table, candidate_values, search, summarize_folds, to_config, operating_points

PENALTY = 0.5  # Fixed value: weight of the spread in the composite score.
# Batch settings.
BATCHES, BATCH_SIZE, POOL, KAPPA, XI = 3, 8, 400, 1.5, 0.001
MIN_SHARES = {"family": 0.10, "selector": 0.05, "balancer": 0.05}
REFINE_N, REFINE_SHRINK = 12, 0.4
MIN_ROWS = 20


def meta_table(folds: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate axes with mean, deviation, range, variation and composite score; unscored candidates go."""
    joined = candidates.join(summarize_folds(folds), "candidate").where("mean_pr_auc is not null")
    return joined.withColumn("cv_pr_auc", F.col("std_pr_auc") / F.greatest(F.col("mean_pr_auc"), F.lit(1e-6))).withColumn(
        "uncertainty_aware_score", F.col("mean_pr_auc") - PENALTY * F.col("std_pr_auc")
    )


@dataclass
class AxisEncoder:
    """Median for missing numbers, one slot per category; a category unseen at fit time has no slot."""

    numbers: dict[str, float]
    categories: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [f"{c}={v}" for c, vs in self.categories.items() for v in vs] + list(self.numbers)

    def columns(self) -> list[Column]:
        cat = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("absent"))
        hot = [F.when(cat(c) == v, 1.0).otherwise(0.0) for c, vs in self.categories.items() for v in vs]
        return hot + [F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.numbers.items()]

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        return df.withColumn(out, array_to_vector(F.array(*self.columns())))


def fit_encoder(df: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str]) -> AxisEncoder:
    """Category lists come from one grouped pass; columns without any number are filled with 0."""
    meds = medians(df, num_cols) if num_cols else {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("absent")).alias("v")) for c in cat_cols
    ])).alias("e")).select("e.c", "e.v").distinct() if cat_cols else None
    found: dict[str, list[str]] = {c: [] for c in cat_cols}
    for r in (long.collect() if long is not None else []):
        found[r["c"]].append(r["v"])
    return AxisEncoder({c: m if m is not None else 0.0 for c, m in meds.items()}, {c: sorted(v) for c, v in found.items()})


@dataclass
class BoostedModel:
    """A fitted booster, or its trees in files, with the ``transform`` of an MLlib regressor."""

    booster: Boosted | TreeFiles

    def transform(self, df: DataFrame) -> DataFrame:
        if isinstance(self.booster, TreeFiles):
            return df.withColumn("yhat", F.get(self.booster.scored(vector_to_array("features")), F.lit(0)))
        return df.withColumn("yhat", self.booster.predict(vector_to_array("features")))


@dataclass
class BoostedRegressor:
    """Boosted or random trees on ``features`` and ``y``; :func:`cross_predict` fits the models of all folds in one go."""

    spec: BoostSpec
    fitter: Callable = fit_boosters

    def fit(self, df: DataFrame) -> BoostedModel:
        keyed = df.select("features", "y", F.xxhash64(vector_to_array("features"), "y").alias("_key"))
        kept = {"files": True} if self.spec.growth == "random" else {}
        return BoostedModel(self.fitter(keyed, vector_to_array("features"), F.col("y"), "_key", [Run(self.spec)], **kept)[0])


@dataclass
class ForestModel:
    """A forest that grew next to its rows, with the ``transform`` of an MLlib regressor."""

    files: TreeFiles

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("yhat", F.get(self.files.scored(vector_to_array("features")), F.lit(0)))


@dataclass
class ForestRegressor:
    """A forest on ``features`` and ``y``, with ``yhat``: MLlib's, its rows dealt out by their number and that of the trees, or that of :mod:`operators.forests`."""

    options: dict

    def fit(self, df: DataFrame):
        rows, n_trees = df.select("features", "y").persist(), self.options["numTrees"]
        try:
            n = rows.count()
            p = rows.first()["features"].size if n else 0
            if self.options.get("bootstrap", True) and grows_here(n, p, n_trees):
                n_try = features_tried(self.options.get("featureSubsetStrategy", "auto"), p, n_trees, 0)
                spec = ForestSpec(n_trees, self.options["maxDepth"], self.options["minInstancesPerNode"], n_try, 0, self.options["seed"])
                return ForestModel(fit_forest(rows, vector_to_array("features"), F.col("y"), spec))
            data = forest_partitions(rows, n, n_trees=n_trees)
            return RandomForestRegressor(featuresCol="features", labelCol="y", predictionCol="yhat", **self.options, **forest_settings(df.sparkSession)).fit(data)
        finally:
            rows.unpersist()


def regressors(n_trees: int = 500, n_rounds: int = 400, seed: int = 42) -> dict[str, Callable]:
    """Regressor presets, of which :func:`compare_regressors` takes ``COMPARED``; forests grow as deep as Spark allows."""
    deep = {"numTrees": n_trees, "maxDepth": 30, "minInstancesPerNode": 2, "seed": seed}
    level = BoostSpec(n_rounds, 0.05, "level", 6, 0, 0.0, 1.0, 0.0, 1.0, 1, 0.9, 0.9, "squared", None, seed)
    leaf = BoostSpec(n_rounds, 0.05, "leaf", 0, 31, 0.0, 0.0, 0.0, 1e-3, 5, 1.0, 1.0, "squared", None, seed)
    return {
        "forest": lambda: ForestRegressor(deep),
        "spread_forest": lambda: ForestRegressor(deep | {"bootstrap": False, "featureSubsetStrategy": "onethird"}),
        "extra_trees": lambda: BoostedRegressor(random_spec(n_trees, 30, 2, seed), fit_random_trees),
        "boosted": lambda: BoostedRegressor(level),
        "boosted_wide": lambda: BoostedRegressor(leaf),
    }


#: Presets compared unless others are given.
COMPARED = ("forest", "extra_trees", "boosted", "boosted_wide")
#: Rows of a partition while forests are fitted, and forests fitted at a time.
FIT_ROWS, PARALLEL_FITS = 50_000, 6


def cross_predict(df: DataFrame, models: Mapping[str, Callable], row_id: str, n_folds: int = 5, seed=42) -> DataFrame:
    """``(model, fold, row_id, y, yhat)`` from an encoded table (``features``, ``y``).

    Boosted models of all folds share their passes. Random trees are as large as their rows, so a fold's are fitted, asked and dropped before the next
    fold's; many of them never leave their files. Other fits are submitted by a bounded number of threads.
    """
    keyed = df.withColumn("_h", hash_key(seed, row_id))
    tagged = global_rank(keyed, "_h", "_r", ties=[row_id], hashed=True).withColumn("fold", ((F.col("_r") - 1) % n_folds).cast("int"))
    tagged = tagged.select(row_id, "features", "y", "fold").persist()
    parts = max(1, -(-tagged.count() // FIT_ROWS))
    made = {name: make() for name, make in models.items()}
    boosted = [name for name, m in made.items() if isinstance(m, BoostedRegressor)]
    done, parted = {}, []
    predicted = lambda name, fold, model: model.transform(tagged.where(F.col("fold") == fold)).select(F.lit(name).alias("model"), "fold", row_id, "y", "yhat")
    for fitter in dict.fromkeys(made[name].fitter for name in boosted):
        tasks = [(name, fold) for name in boosted if made[name].fitter is fitter for fold in range(n_folds)]
        runs = [Run(made[name].spec, (F.col("fold") != fold).cast("double")) for name, fold in tasks]
        if made[tasks[0][0]].spec.growth == "random":
            weight = sum((r.weight for r in runs), F.lit(0.0))
            for (name, fold), run in zip(tasks, runs):
                model = BoostedModel(fitter(tagged, vector_to_array("features"), F.col("y"), row_id, [run], cut_weight=weight, files=True)[0])
                parted.append(cut_lineage(predicted(name, fold, model)))
            continue
        done |= zip(tasks, map(BoostedModel, fitter(tagged, vector_to_array("features"), F.col("y"), row_id, runs)))
    work = [(name, fold) for name in made if name not in boosted for fold in range(n_folds)]

    def one(w):
        train = tagged.where(F.col("fold") != w[1]).coalesce(parts).persist()
        try:
            return models[w[0]]().fit(train)
        finally:
            train.unpersist()

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        done |= zip(work, pool.map(one, work))
    out = None
    for part in [*parted, *(predicted(name, fold, model) for (name, fold), model in done.items())]:
        out = part if out is None else out.unionByName(part)
    return out


def score_regressors(predictions: DataFrame) -> DataFrame:
    """Mean over folds of R squared, MAE, RMSE and Spearman per model."""
    by = ["model", "fold"]
    per_fold = regression_errors(predictions, by).join(spearman(predictions, by), by)
    return per_fold.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("r2", "mae", "rmse", "spearman")])


def compare_regressors(df: DataFrame, row_id: str, models: Mapping[str, Callable] | None = None, n_folds: int = 5, seed=42) -> tuple[str, DataFrame]:
    """(best model by Spearman, scores); needs enough rows to be worth comparing."""
    if df.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} rows are needed")
    chosen = models or {name: make for name, make in regressors().items() if name in COMPARED}
    predictions = cut_lineage(cross_predict(df, chosen, row_id, n_folds, seed))  # read by every score; a plan with all models in it is large
    scores = score_regressors(predictions).persist()
    best = scores.orderBy(F.col("spearman").desc(), "model").first()["model"]
    return best, scores


# ---- importance -------------------------------------------------------------------------------


def permutation_importance(df: DataFrame, model, names: Sequence[str], row_id: str, repeats: int = 20, seed=42) -> DataFrame:
    """Drop in R squared when one feature is shuffled: mean and deviation over repeats, and a noise flag.

    A shuffle pairs each row with the row of the same rank in another digest
    order, so values move by an equi-join. Only rows whose value of a feature
    changes are scored again; the others keep their error.
    """
    base = model.transform(df).select(row_id, "y", vector_to_array("features").alias("x"), "yhat").persist()
    error = F.col("y") - F.col("yhat")
    whole = base.agg(F.count(F.lit(1)).alias("rows"), F.count(error).alias("n"), F.sum(error * error).alias("s"), F.var_pop("y").alias("v")).first()
    r2 = lambda s: 1 - F.try_divide(s / F.lit(whole["n"]), F.lit(whole["v"]).cast("double"))
    own = global_rank(base.withColumn("_h", hash_key(f"{seed}:base", row_id)), "_h", "_r", ties=[row_id], hashed=True).drop("_h")
    spread = own.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    other = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_h", hash_key(seed, "rep", row_id))
    other = global_rank(other, "_h", "_r", by=["rep"], ties=[row_id], hashed=True).select("rep", "_r", F.col("x").alias("z"))
    paired = spread.join(other, ["rep", "_r"])
    places = F.sequence(F.lit(0), F.lit(len(names) - 1))
    shuffled = paired.withColumn("j", F.explode(F.filter(places, lambda j: ~F.get("x", j).eqNullSafe(F.get("z", j)))))
    mixed = F.transform("x", lambda v, i: F.when(i == F.col("j"), F.get("z", i)).otherwise(v))
    rows = shuffled.select("rep", "j", "y", (error * error).alias("_was"), array_to_vector(mixed).alias("features"))
    moved = model.transform(rows).groupBy("rep", "j").agg(F.sum(error * error - F.col("_was")).alias("_more"))
    grid = df.sparkSession.range(repeats * len(names) if whole["rows"] else 0).select((F.col("id") % repeats).cast("int").alias("rep"), F.floor(F.col("id") / repeats).cast("int").alias("j"))
    s = F.lit(whole["s"]).cast("double")
    drop = r2(s) - r2(s + F.coalesce(F.col("_more"), F.lit(0.0)))
    drops = grid.join(moved, ["rep", "j"], "left").groupBy("j").agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("importance_std"))
    named = drops.withColumn("feature", F.get(F.array(*map(F.lit, names)), F.col("j"))).drop("j")
    return named.withColumn("is_noise", (F.col("importance") <= 2 * F.col("importance_std")) & (F.col("importance") < 0.001))


def shapley_importance(df: DataFrame, model, names: Sequence[str], row_id: str, samples: int = 10, seed=42) -> DataFrame:
    """Mean absolute Shapley value per feature, by sampled feature orders and background rows.

    For each (row, sample) a digest orders the features; walking that order,
    features switch from the background row's value to the row's own, and the
    prediction gain is credited to the feature that switched.
    """
    p = len(names)
    base = df.select(row_id, vector_to_array("features").alias("x")).persist()
    own = global_rank(base.withColumn("_h", hash_key(f"{seed}:base", row_id)), "_h", "_r", ties=[row_id], hashed=True).drop("_h")
    reps = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    background = base.withColumn("s", reps).withColumn("_h", hash_key(f"{seed}:bg", "s", row_id))
    background = global_rank(background, "_h", "_r", by=["s"], ties=[row_id], hashed=True).select("s", "_r", F.col("x").alias("z"))
    paired = own.withColumn("s", reps).join(background, ["s", "_r"])
    order = F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id), F.col("s"), j)).alias("h"), j.alias("j")))),
        lambda e: e["j"],
    )
    steps = paired.withColumn("order", order).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(p))))
    switched = F.slice("order", F.lit(1), F.col("step"))
    blend = F.transform("x", lambda v, i: F.when(F.array_contains(switched, i), v).otherwise(F.get("z", i)))
    scored = model.transform(steps.select(row_id, "s", "step", "order", array_to_vector(blend).alias("features")))
    w = W.partitionBy(row_id, "s").orderBy("step")
    gains = scored.select(row_id, "s", "step", "order", (F.col("yhat") - F.lag("yhat").over(w)).alias("gain")).where("step > 0")
    credited = gains.select(row_id, F.get("order", F.col("step") - 1).alias("j"), "gain")
    per_row = credited.groupBy(row_id, "j").agg(F.avg("gain").alias("phi"))
    mean = per_row.groupBy("j").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
    return mean.select(F.get(F.array(*map(F.lit, names)), F.col("j")).alias("feature"), "mean_abs_shap")


def linear_shap(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Exact mean absolute Shapley value of a linear model: ``w (x - mean)``."""
    means = df.agg(*[F.avg(c).alias(c) for c in weights]).first()
    wide = df.agg(*[F.avg(F.abs(F.lit(w) * (F.col(c) - F.lit(means[c])))).alias(c) for c, w in weights.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs_shap")) for c in weights])).alias("e")).select("e.*")


# ---- response surface -------------------------------------------------------------------------


def surface_grid(df: DataFrame, a: str, b: str, cat_cols: Sequence[str], num_cols: Sequence[str], steps: int = 30) -> DataFrame:
    """Grid over two axes between their extremes; other axes at their median or most frequent value."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    fixed = medians(df, [c for c in num_cols if c not in (a, b)])
    modes = {}
    for c in cat_cols:
        first = modal_value(df, c).first()
        modes[c] = first[c] if first else None
    place = lambda c, i: F.lit(row[f"lo_{c}"]).cast("double") + i * F.lit((row[f"hi_{c}"] - row[f"lo_{c}"]) / (steps - 1))
    cells = df.sparkSession.range(steps * steps).select((F.col("id") % steps).alias("ia"), F.floor(F.col("id") / steps).alias("ib"))
    return cells.select(
        F.col("ia").cast("int").alias("ia"), F.col("ib").cast("int").alias("ib"), place(a, F.col("ia")).alias(a), place(b, F.col("ib")).alias(b),
        *[F.lit(v).cast("double").alias(c) for c, v in fixed.items()], *[F.lit(v).alias(c) for c, v in modes.items()],
    )


def category_spread(df: DataFrame, cat_cols: Sequence[str], score: str) -> DataFrame:
    """Five-number summary of the score per category of each axis."""
    from ..operators.quantiles import group_quantiles

    long = df.select(score, F.explode(F.array(*[
        F.struct(F.lit(c).alias("axis"), F.col(c).cast("string").alias("category")) for c in cat_cols
    ])).alias("e")).select(score, "e.*").where("category is not null")
    boxes = group_quantiles(long, ["axis", "category"], {"p25": (score, 0.25), "median": (score, 0.5), "p75": (score, 0.75)})
    ends = long.groupBy("axis", "category").agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("min"), F.max(score).alias("max"))
    return ends.join(boxes, ["axis", "category"])


# ---- acquisition ------------------------------------------------------------------------------


@dataclass
class PackedForest:
    """All trees of a forest as arrays one behind the other; ``root`` has the place of each tree's first node, ``cover`` the training rows of a node.

    A prediction is the mean of the trees (``averaged``), or their sum, and ``base``.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    cover: np.ndarray
    averaged: bool = True
    base: float = 0.0

    def each(self, x: np.ndarray) -> np.ndarray:
        """Predictions, rows x trees."""
        at = np.tile(self.root, (len(x), 1))
        row = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.value[at]
            goes_left = x[row, np.maximum(feature, 0)] <= self.cut[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)


def pack_forest(spark, forest) -> PackedForest | TreeFiles:
    """The nodes of an MLlib forest, read from its saved form; their number is that of the model, not of any table. Trees in files stay there."""
    if isinstance(forest, ForestModel):
        return forest.files
    path = scratch_path(spark, "forest")
    forest.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild", "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"), (F.col("nodeData.split.numCategories") >= 0).alias("by_set")).toPandas()
    nodes = nodes.sort_values(["treeID", "id"], ignore_index=True)
    inner = (nodes["leftChild"] >= 0).to_numpy()
    if (nodes["by_set"].to_numpy() & inner).any():
        raise ValueError("splits by sets of categories are not packed")
    root = np.flatnonzero(nodes["id"].to_numpy() == 0)
    first = np.repeat(root, np.diff(np.append(root, len(nodes))))
    place = lambda c: np.where(inner, first + nodes[c].to_numpy(), 0)
    return PackedForest(
        np.where(inner, nodes["feature"].to_numpy(), -1), nodes["cut"].to_numpy(), place("leftChild"), place("rightChild"), nodes["prediction"].to_numpy(), root,
        nodes["rawCount"].to_numpy().astype(float))


def pack_boosted(model: Boosted) -> PackedForest:
    """The trees of a booster, whose scores are sums, or of random trees, whose score is a mean; nodes weigh by their hessian."""
    if not model.trees:
        raise ValueError("a model without trees has nothing to pack")
    first = np.cumsum([0, *(len(t.feature) for t in model.trees[:-1])])
    join = lambda name: np.concatenate([np.array(getattr(t, name)) for t in model.trees])
    child = lambda name: np.concatenate([np.maximum(np.array(getattr(t, name)), 0) + f for t, f in zip(model.trees, first)])
    value, mean = join("value"), model.spec.growth == "random"
    if mean:
        value = value * len(model.trees) + model.start
    return PackedForest(join("feature"), join("cut"), child("left"), child("right"), value, first, join("hess"), mean, 0.0 if mean else model.start)


#: Cells (rows x trees) scored at a time.
SPREAD_CELLS = 2_000_000


def tree_spread(df: DataFrame, forest, keep: Sequence[str]) -> DataFrame:
    """Mean and population deviation over the trees of a forest, row by row, in one pass over the packed trees."""
    files = forest.files if isinstance(forest, ForestModel) else forest.booster if isinstance(forest, BoostedModel) else None
    if isinstance(files, TreeFiles):
        told = df.withColumn("_spread", files.scored(vector_to_array("features"), spread=True))
        return told.select(*keep, F.get("_spread", F.lit(0)).alias("mu"), F.get("_spread", F.lit(1)).alias("sigma"))
    packed = forest
    if isinstance(forest, BoostedModel):
        packed = pack_boosted(forest.booster)
    elif not isinstance(forest, PackedForest):
        packed = pack_forest(df.sparkSession, forest)

    @F.pandas_udf("mu double, sigma double")
    def spread(x: pd.Series) -> pd.DataFrame:
        step, parts = max(1, SPREAD_CELLS // len(packed.root)), []
        for low in range(0, len(x), step):
            each = packed.each(np.vstack(x.iloc[low:low + step].to_numpy()))
            parts.append(np.stack([each.mean(axis=1), each.std(axis=1)], axis=1))
        out = np.concatenate(parts) if parts else np.zeros((0, 2))
        return pd.DataFrame({"mu": out[:, 0], "sigma": out[:, 1]})

    return df.withColumn("_spread", spread(vector_to_array("features"))).select(*keep, F.col("_spread.mu").alias("mu"), F.col("_spread.sigma").alias("sigma"))


def spread_of(df: DataFrame, values: str) -> DataFrame:
    """``mu`` and ``sigma`` of an array column, without a shuffle."""
    n = F.size(values)
    mu = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n
    out = df.withColumn("mu", mu)
    var = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - F.col("mu")) * (v - F.col("mu"))) / n
    return out.withColumn("sigma", F.sqrt(var))


def acquisition(mu: Column, sigma: Column, best: float, kind: str = "ucb", kappa: float = KAPPA, xi: float = XI) -> Column:
    """Upper confidence bound or expected improvement."""
    if kind == "ucb":
        return mu + F.lit(kappa) * sigma
    if kind != "ei":
        raise ValueError(f"unknown acquisition: {kind!r}")
    s = F.greatest(sigma, F.lit(1e-9))
    gain = mu - F.lit(best) - F.lit(xi)
    z = gain / s
    return gain * normal_cdf(z) + s * normal_pdf(z)


def select_with_quotas(df: DataFrame, score: str, batch: int, shares: Mapping[str, float], tie: str) -> DataFrame:
    """Best ``batch`` rows with reserved places per attribute value.

    A row holds a reserve when it is among the best of its value.  Places go
    by first-attribute reserve, then number of other reserves, then score, so
    the first attribute's quotas hold whenever they fit in the batch.
    Ranking stops at the quota, so Spark trims every partition first.
    """
    attrs = list(shares)
    marked = df
    for a in attrs:
        quota = max(1, int(round(shares[a] * batch)))
        rank = F.row_number().over(W.partitionBy(a).orderBy(F.col(score).desc(), tie))
        held = df.select(tie, a, score).withColumn("_k", rank).where(F.col("_k") <= quota).select(tie, F.lit(1).alias(f"_r_{a}"))
        marked = marked.join(held, tie, "left")
    reserves = [F.coalesce(F.col(f"_r_{a}"), F.lit(0)) for a in attrs]
    others = sum(reserves[1:], F.lit(0))
    return marked.orderBy(reserves[0].desc(), others.desc(), F.col(score).desc(), tie).limit(batch).drop(*[f"_r_{a}" for a in attrs])


def trust_region(dims: DataFrame, best: Mapping, shrink: float = REFINE_SHRINK) -> DataFrame:
    """Dimensions of the best row's family with linear and log ranges cut to half of ``shrink`` around its values."""
    values = {k: float(v) for k, v in best.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    centre = F.lit(None).cast("double")
    for name, value in values.items():
        centre = F.when(F.col("name") == name, F.lit(value)).otherwise(centre)
    own = dims.where(F.col("family") == best["family"]).withColumn("_v", centre)
    half_lin = 0.5 * shrink * (F.col("hi") - F.col("lo"))
    half_log = 0.5 * shrink * (F.ln("hi") - F.ln("lo"))
    lo = F.when(F.col("kind") == "lin", F.greatest(F.col("lo"), F.col("_v") - half_lin)).when(
        F.col("kind") == "log", F.greatest(F.col("lo"), F.exp(F.ln("_v") - half_log)))
    hi = F.when(F.col("kind") == "lin", F.least(F.col("hi"), F.col("_v") + half_lin)).when(
        F.col("kind") == "log", F.least(F.col("hi"), F.exp(F.ln("_v") + half_log)))
    cut = F.col("_v").isNotNull() & F.col("_lo").isNotNull() & (F.col("_hi") > F.col("_lo"))
    return own.withColumns({"_lo": lo, "_hi": hi}).select(
        "family", "name", "kind", F.when(cut, F.col("_lo")).otherwise(F.col("lo")).alias("lo"),
        F.when(cut, F.col("_hi")).otherwise(F.col("hi")).alias("hi"), "none_frac", "items",
    )


def append_batch(meta: DataFrame, rows: DataFrame, batch: str) -> DataFrame:
    """Union by name; columns one side lacks are null and ``_batch`` tells where a row came from."""
    tagged = meta if "_batch" in meta.columns else meta.withColumn("_batch", F.lit("-1"))
    return tagged.unionByName(rows.withColumn("_batch", F.lit(batch)), allowMissingColumns=True)


def optimize(df: DataFrame, features: Sequence[str], label: str, row_id: str, meta: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str],
             dims: DataFrame, spw_base: float, batches: int = BATCHES, batch_size: int = BATCH_SIZE, pool: int = POOL, refine: int = REFINE_N,
             kind: str = "ucb", n_folds: int = 5, n_trees: int = 100, seed: int = 42, quotas: Mapping[str, float] | None = None) -> DataFrame:
    """Batches of new candidates chosen by the surrogate, then a refinement around the best one.

    The driver only steers: fits, pool scoring and selection are Spark jobs.
    """
    spark = df.sparkSession
    target = "uncertainty_aware_score"
    quotas = quotas or {r["family"]: 1.0 for r in dims.select("family").distinct().collect()}
    quotas = {k: v / sum(quotas.values()) for k, v in quotas.items()}
    starts: dict = {}  # first steps of the chains, the same for all batches
    for b in range(batches):
        encoder = fit_encoder(meta, cat_cols, num_cols)
        train = encoder.transform(meta).select("features", F.col(target).alias("y"))
        forest = BoostedRegressor(random_spec(n_trees, 30, 2, seed + b), fit_random_trees).fit(train)
        best = meta.agg(F.max(target)).first()[0]
        fresh = _complete(candidate_table(candidate_values(spark, spw_base, pool, quotas, seed + 100 + b, dims)), cat_cols, num_cols)
        spread = tree_spread(encoder.transform(fresh), forest, fresh.columns)
        scored = spread.withColumn("acq", acquisition(F.col("mu"), F.col("sigma"), best, kind))
        chosen = select_with_quotas(scored, "acq", batch_size, MIN_SHARES, "candidate")
        meta = _evaluate_into(meta, chosen.drop("mu", "sigma", "acq"), df, features, label, row_id, n_folds, seed, f"{b}", starts)
    best_row = meta.orderBy(F.col(target).desc(), "candidate").first().asDict()
    near = trust_region(dims, best_row)
    values = candidate_values(spark, spw_base, refine, {best_row["family"]: 1.0}, seed + 999, spark.createDataFrame(near.collect(), DIMENSION_SCHEMA))
    return _evaluate_into(meta, _complete(candidate_table(values), cat_cols, num_cols), df, features, label, row_id, n_folds, seed, "TR", starts)


def _complete(table: DataFrame, cat_cols, num_cols) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in cat_cols if c not in table.columns}
    missing |= {c: F.lit(None).cast("double") for c in num_cols if c not in table.columns}
    return table.withColumns(missing) if missing else table


def _evaluate_into(meta, chosen, df, features, label, row_id, n_folds, seed, batch, starts):
    spark = df.sparkSession
    rows = [r.asDict() for r in chosen.collect()]  # at most one batch
    named = {f"b{batch}-{r['candidate']}": r for r in rows}
    folds = search(df, features, label, row_id, {k: to_config(r) for k, r in named.items()}, n_folds, seed, starts=starts)
    table = spark.createDataFrame([{**r, "candidate": k} for k, r in named.items()], chosen.schema)
    fresh = meta_table(folds, table).persist()
    return append_batch(meta, fresh, batch)


# ---- stability --------------------------------------------------------------------------------


def stability_scores(df: DataFrame, features: Sequence[str], label: str, row_id: str, configs: Mapping[str, ChainConfig],
                     n_folds: int = 5, n_repeats: int = 3, seed: int = 42) -> DataFrame:
    """``(candidate, repeat, fold, row_id, label, score)`` over repeated stratified folds."""
    dealt = repeated_folds(df.select(row_id, label, *features), label, row_id, n_folds, n_repeats, seed).persist()
    tagged = dealt.coalesce(max(1, -(-dealt.count() // FIT_ROWS))).persist()  # a fit makes many passes over few rows
    tagged.count()
    dealt.unpersist()
    work = [(name, repeat, fold) for name in configs for repeat in range(n_repeats) for fold in range(n_folds)]

    def one(w):
        name, repeat, fold = w
        scored = _scores(tagged, list(features), label, row_id, configs[name], f"fold_{repeat}", fold, seed)
        # Written down at once: a plan that holds all chains is large, and each of its readers plans it again.
        return cut_lineage(scored.select(F.lit(name).alias("candidate"), F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), row_id, "label", "score"))

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        parts = list(pool.map(one, work))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stability_table(scores: DataFrame) -> DataFrame:
    """Means and deviations over folds, and a score that rewards a high, steady and calibrated candidate."""
    by = ["candidate", "repeat", "fold"]
    # Scores come out of many fitted chains; they are computed once.
    folds = operating_points(scores.persist(), by)
    values = {"pr_auc": "pr", "roc_auc": "roc", "brier": "brier", "f1_threshold": "f1_threshold", "recall_at_spec": "recall_at_spec"}
    aggs = [f(c).alias(f"{n}_{s}") for c, n in values.items() for s, f in (("mean", F.avg), ("std", F.stddev_pop))]
    out = folds.groupBy("candidate").agg(*aggs)
    return out.withColumn("stability_score", F.col("pr_mean") - 0.5 * F.col("pr_std") - 0.5 * F.col("brier_mean"))


def top_survivors(meta: DataFrame, k: int = 5, score: str = "uncertainty_aware_score") -> DataFrame:
    return meta.orderBy(F.col(score).desc(), "candidate").limit(k)


def freeze_winner(train: DataFrame, holdout: DataFrame, features: Sequence[str], label: str, row_id: str, config: ChainConfig, seed: int = 42):
    """Refit the winner and recompute its thresholds on hold-out rows: (chain, metadata)."""
    chain = fit_chain(train, features, label, row_id, config, seed)
    scored = chain.transform(holdout.select(row_id, label, *features)).select(F.col(label).cast("int").alias("label"), F.col("probability")[1].alias("score"))
    return chain, operating_points(scored).first().asDict()
