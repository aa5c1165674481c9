"""Classifier families: boosted trees of :mod:`.boosting`, the rest on MLlib.  Every fitted family adds a ``probability`` array column, one value per class."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from .boosting import Boosted, BoostSpec, Run, fit_boosters
from .forests import ForestSpec, features_tried, fit_forest
from .kernel_machine import KernelMachine, fit_machines
from .select import assemble, forest_partitions, forest_settings
from .split import stratified_folds, with_balanced_weight
from .tree_files import TreeFiles, grows_here

DEEPEST = 30  # Fixed value: MLlib trees stop at this depth.

# Default parameters of each family.
DEFAULTS = {
    "lr": {"C": 1.0, "penalty": "l2", "max_iter": 1000},
    "svc": {"C": 1.0, "n_components": None, "max_iter": 200},
    "rf": {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1, "max_features": "sqrt"},
    "xgb": {"n_estimators": 200, "learning_rate": 0.1, "max_depth": 5, "min_child_weight": 1, "subsample": 1.0, "colsample_bytree": 1.0, "reg_alpha": 0.0,
            "reg_lambda": 1.0, "scale_pos_weight": 1.0, "gamma": 0.0},
    "lgbm": {"n_estimators": 200, "learning_rate": 0.1, "num_leaves": 31, "min_child_samples": 20, "reg_alpha": 0.0, "reg_lambda": 0.0, "subsample": 1.0,
             "colsample_bytree": 1.0, "scale_pos_weight": None},
    "catboost": {"iterations": 300, "learning_rate": 0.1, "depth": 6, "l2_leaf_reg": 3.0},
    "mlp": {"hidden": (100,), "max_iter": 500},
    "stacker": {"xgb": {"n_estimators": 300, "subsample": 0.9, "colsample_bytree": 0.9},
                "lgbm": {"n_estimators": 300, "learning_rate": 0.05}, "lr": {}, "cv": 3, "inner_cv": 5},
}
BOOSTED = ("xgb", "lgbm", "catboost")
# Parameters that change nothing in the library that the family is named after, with the settings around them; they are recorded.
IGNORED = {"lgbm": ("subsample",)}  # rows are sampled there only where a bagging frequency is set
#: Rows of a partition while a small table is fitted again and again.
FIT_ROWS = 50_000
#: Fits submitted at a time.
PARALLEL_FITS = 4


def boost_spec(family: str, cfg: dict, seed: int = 42) -> BoostSpec:
    """Boosting settings of a family's parameters."""
    if family == "xgb":
        return BoostSpec(
            int(cfg["n_estimators"]), cfg["learning_rate"], "level", int(cfg["max_depth"]), 0, cfg["reg_alpha"], cfg["reg_lambda"], cfg["gamma"],
            cfg["min_child_weight"], 1, cfg["subsample"], cfg["colsample_bytree"], start=0.0, seed=seed)
    if family == "lgbm":
        return BoostSpec(
            int(cfg["n_estimators"]), cfg["learning_rate"], "leaf", 0, int(cfg["num_leaves"]), cfg["reg_alpha"], cfg["reg_lambda"], 0.0, 1e-3,
            int(cfg["min_child_samples"]), 1.0, cfg["colsample_bytree"], start=None, seed=seed)
    return BoostSpec(int(cfg["iterations"]), cfg["learning_rate"], "symmetric", int(cfg["depth"]), 0, 0.0, cfg["l2_leaf_reg"], min_hessian=0.0, start=0.0, seed=seed)


def feature_array(features: Sequence[str]) -> Column:
    """Feature values as doubles; a missing one is NaN."""
    return F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in features))


def _boost_weight(family: str, cfg: dict, is_second: Column, counts: dict[bool, int]) -> Column:
    """Row weight of a boosted family; ``counts``: rows of the second class (True) and of the first."""
    if family == "xgb" or family == "lgbm" and cfg["scale_pos_weight"] is not None:
        return F.when(is_second, F.lit(float(cfg["scale_pos_weight"]))).otherwise(F.lit(1.0))
    total = sum(counts.values())
    return F.when(is_second, F.lit(total / (2 * max(counts.get(True, 0), 1)))).otherwise(F.lit(total / (2 * max(counts.get(False, 0), 1))))


@dataclass
class FittedModel:
    family: str
    params: dict
    features: list[str]
    classes: list[float]
    model: object
    extra: dict = field(default_factory=dict)
    ignored: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (array) next to the input columns."""
        if self.family == "stacker":
            return self.model.transform(df)
        if self.family in BOOSTED:
            p = df.withColumn("_p", self.model.predict(feature_array(self.features)))
            return p.select(*df.columns, F.array(1 - F.col("_p"), F.col("_p")).alias("probability"))
        if isinstance(self.model, KernelMachine):
            p = assemble(df, self.features, "_x").withColumn("_p", self.model.probability(vector_to_array("_x")))
            return p.select(*df.columns, F.array(1 - F.col("_p"), F.col("_p")).alias("probability"))
        if isinstance(self.model, TreeFiles):
            p = assemble(df, self.features, "_x").withColumn("probability", self.model.scored(vector_to_array("_x")))
            return p.select(*df.columns, "probability")
        data = assemble(df, self.features, "_x")
        if self.family == "svc":
            data = data.withColumn("_z", self.extra["map"](vector_to_array("_x")))
            data = self.model.transform(data.withColumn("_x", array_to_vector("_z")).drop("_z"))
            margin = vector_to_array("_raw")[1]
            p = 1 / (1 + F.exp(-(F.lit(self.extra["slope"]) * margin + F.lit(self.extra["intercept"]))))
            scored = data.withColumn("probability", F.array(1 - p, p))
        else:
            scored = self.model.transform(data).withColumn("probability", vector_to_array("_p"))
        return scored.select(*df.columns, "probability")


def _outputs(weight: str | None = None) -> dict:
    out = {"featuresCol": "_x", "labelCol": "_y", "probabilityCol": "_p", "rawPredictionCol": "_raw", "predictionCol": "_pred"}
    return out | ({"weightCol": weight} if weight else {})


def random_features(dim: int, n_components: int, gamma: float, seed: int):
    """Arrow function mapping a vector to cosines whose dot product approximates an RBF kernel."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), (dim, n_components))
    b = rng.uniform(0.0, 2.0 * math.pi, n_components)

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        z = np.cos(np.vstack(x.to_numpy()) @ w + b) * math.sqrt(2.0 / n_components)
        return pd.Series(list(z))

    return apply


def fit_model(df: DataFrame, features: Sequence[str], label: str, family: str, params: dict | None = None,
              row_id: str = "row_id", seed: int = 42) -> FittedModel:
    """Fit one family; unknown families raise."""
    if family not in DEFAULTS:
        raise ValueError(f"unknown family: {family!r}")
    features = list(features)
    given = dict(params or {})
    ignored = {k: given.pop(k) for k in IGNORED.get(family, ()) if k in given}
    cfg = {**DEFAULTS[family], **given}
    if family == "stacker":
        return fit_stacker(df, features, label, cfg, row_id, seed)
    counts = {float(r[label]): r["count"] for r in df.groupBy(label).count().collect()}
    classes = sorted(counts)
    n, n_classes = sum(counts.values()), len(classes)
    data = assemble(df, features, "_x").withColumn("_y", F.col(label).cast("double"))
    data = with_balanced_weight(data, "_y", "_w", counts)
    extra: dict = {}

    if family == "lr":
        est = LogisticRegression(
            regParam=1.0 / (cfg["C"] * max(n, 1)), elasticNetParam=1.0 if cfg["penalty"] == "l1" else 0.0,
            maxIter=cfg["max_iter"], standardization=False, **_outputs("_w"),
        )
    elif family == "svc":
        if cfg["n_components"] is None:
            return FittedModel(family, cfg, features, classes, _fit_kernel(data, features, cfg, classes, row_id, seed)[0], extra, ignored)
        return _fit_svc(data, features, cfg, classes, n, seed, ignored)
    elif family == "rf":
        n_trees, depth = int(cfg["n_estimators"]), min(cfg["max_depth"] or DEEPEST, DEEPEST)
        whole = classes == [float(k) for k in range(n_classes)]  # MLlib takes no other classes
        if n_classes > 1 and whole and grows_here(n, len(features), n_trees):
            spec = ForestSpec(n_trees, depth, cfg["min_samples_leaf"], features_tried(str(cfg["max_features"]), len(features), n_trees, n_classes), n_classes, seed)
            return FittedModel(family, cfg, features, classes, fit_forest(data, vector_to_array("_x"), F.col("_y"), spec, F.col("_w")), extra, ignored)
        est = RandomForestClassifier(
            numTrees=n_trees, maxDepth=depth,
            minInstancesPerNode=cfg["min_samples_leaf"], featureSubsetStrategy=str(cfg["max_features"]), seed=seed,
            **_outputs("_w"), **forest_settings(df.sparkSession),
        )
    elif family == "mlp":
        est = MultilayerPerceptronClassifier(layers=[len(features), *cfg["hidden"], max(n_classes, 2)], maxIter=cfg["max_iter"], seed=seed, **_outputs())
    else:
        if n_classes > 2:
            raise ValueError(f"{family} handles two classes, got {n_classes}")
        second = F.col("_y") == classes[-1] if n_classes == 2 else F.col("_y") == 1
        by_class = {c == (classes[-1] if n_classes == 2 else 1.0): k for c, k in counts.items()}
        run = Run(boost_spec(family, cfg, seed), _boost_weight(family, cfg, second, by_class))
        rows = df.withColumn("_y", F.col(label).cast("double"))
        model = fit_boosters(rows, feature_array(features), second.cast("double"), row_id, [run])[0]
        return FittedModel(family, cfg, features, classes, model, extra, ignored)
    train = data.select("_x", "_y", "_w")
    train = (forest_partitions(train, n, fewest=True) if family == "rf" else train.coalesce(max(1, -(-n // FIT_ROWS)))).persist()
    try:
        model = est.fit(train)
    finally:
        train.unpersist()
    return FittedModel(family, cfg, features, classes, model, extra, ignored)


#: Folds whose margins give the probability curve of a kernel machine.
CURVE_FOLDS = 5


def _fit_kernel(data: DataFrame, features, cfg, classes, row_id: str, seed: int) -> tuple[KernelMachine, DataFrame]:
    """The machine on all rows, with a logistic curve over the margins of machines that didn't see the row; and the multipliers of its dual."""
    xs = vector_to_array("_x")
    flat = data.select(F.explode(xs).alias("v")).agg(F.var_pop("v")).first()[0]
    gamma = 1.0 / (len(features) * (flat or 1.0))
    tagged = stratified_folds(data.select(row_id, "_x", "_y", "_w"), "_y", row_id, CURVE_FOLDS, f"{seed}:curve", "_fold").persist()
    top = F.lit(float(cfg["C"])) * F.col("_w")
    tops = [top, *(F.when(F.col("_fold") != k, top) for k in range(CURVE_FOLDS))]
    try:
        machines, duals = fit_machines(tagged, xs, F.col("_y") == classes[-1], F.xxhash64(row_id), tops, gamma)
        own = F.lit(None).cast("double")
        for k in range(CURVE_FOLDS):
            own = F.when(F.col("_fold") == k, machines[k + 1].margin(xs)).otherwise(own)
        margins = tagged.select((F.col("_y") == classes[-1]).cast("double").alias("_y"), own.alias("_m"))
        curve = LogisticRegression(featuresCol="_mv", labelCol="_y").fit(margins.select("_y", array_to_vector(F.array("_m")).alias("_mv")))
    finally:
        tagged.unpersist()
    machine = machines[0]
    machine.slope, machine.shift = float(curve.coefficients[0]), float(curve.intercept)
    return machine, duals[0]


def _fit_svc(data, features, cfg, classes, n, seed, ignored) -> FittedModel:
    """Random Fourier features, a linear machine, and a one-feature logistic fit of the margin."""
    xs = vector_to_array("_x")
    # Kernel width: one over (columns x variance of all cells).
    flat = data.select(F.explode(xs).alias("v")).agg(F.var_pop("v")).first()[0]
    gamma = 1.0 / (len(features) * (flat or 1.0))
    mapper = random_features(len(features), cfg["n_components"], gamma, seed)
    train = data.select("_y", "_w", array_to_vector(mapper(xs)).alias("_x")).persist()
    try:
        svm = LinearSVC(regParam=1.0 / (cfg["C"] * max(n, 1)), maxIter=cfg["max_iter"], standardization=False,
                        featuresCol="_x", labelCol="_y", weightCol="_w", rawPredictionCol="_raw", predictionCol="_pred").fit(train)
        margins = svm.transform(train).select("_y", F.array(vector_to_array("_raw")[1]).alias("_m"))
        platt = LogisticRegression(featuresCol="_mv", labelCol="_y").fit(margins.select("_y", array_to_vector("_m").alias("_mv")))
    finally:
        train.unpersist()
    extra = {"map": mapper, "slope": float(platt.coefficients[0]), "intercept": float(platt.intercept),
             "dim": len(features), "n_components": cfg["n_components"], "gamma": gamma, "seed": seed}
    return FittedModel("svc", cfg, features, classes, svm, extra, ignored)


@dataclass
class _Stack:
    bases: list[FittedModel]
    meta: FittedModel
    calibrator: object

    def raw(self, df: DataFrame) -> DataFrame:
        out = df
        for i, base in enumerate(self.bases):
            out = base.transform(out).withColumn(f"_s{i}", F.col("probability")[1]).drop("probability")
        out = self.meta.transform(out)
        return out.withColumn("_meta", F.col("probability")[1]).drop("probability", *[f"_s{i}" for i in range(len(self.bases))])


@dataclass
class CalibratedStack:
    stacks: list[_Stack]

    def transform(self, df: DataFrame) -> DataFrame:
        """Mean of the calibrated probabilities of the stacks."""
        out = df
        for i, stack in enumerate(self.stacks):
            scored = stack.raw(out)
            out = stack.calibrator.transform(scored).withColumnRenamed("_cal", f"_cal{i}").drop("_meta")
        total = sum((F.col(f"_cal{i}") for i in range(len(self.stacks))), F.lit(0.0)) / len(self.stacks)
        return out.select(*df.columns, F.array(1 - total, total).alias("probability"))


def _picked(models: Sequence[Boosted], which: Column, values: Column) -> Column:
    """Probability by the model whose number ``which`` gives; every row meets one model."""
    @F.pandas_udf("double")
    def scored(number: pd.Series, x: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        for i in np.unique(number.dropna().to_numpy()).astype(int):
            at = np.flatnonzero(number.to_numpy() == i)
            out[at] = 1 / (1 + np.exp(-models[i].margins(np.vstack(x.iloc[at].to_numpy()).astype(np.float64))))
        return pd.Series(out)

    return scored(which, values)


def _linear_probability(model, features: Sequence[str]) -> Column:
    margin = F.lit(float(model.intercept))
    for c, w in zip(features, model.coefficients.toArray().tolist()):
        margin = margin + F.lit(w) * F.col(c).cast("double")
    return 1 / (1 + F.exp(-margin))


def fit_stacker(df: DataFrame, features: list[str], label: str, cfg: dict, row_id: str, seed: int) -> FittedModel:
    """Out-of-fold probabilities of three families feed a balanced logistic fit; isotonic curves calibrate it.

    All boosted models of all folds are fitted together, pass by pass; the linear ones by a few threads.
    """
    cv, inner_cv = cfg["cv"], cfg["inner_cv"]
    second = F.col(label).cast("double") == 1
    tagged = stratified_folds(df.select(row_id, label, *features), label, row_id, cv, f"{seed}:outer", "_outer")
    for held in range(cv):  # rows of the held fold form a class of their own, so the others are dealt as if alone
        own = tagged.withColumn("_c", F.when(F.col("_outer") != held, F.col(label).cast("string")))
        tagged = stratified_folds(own, "_c", row_id, inner_cv, f"{seed}:{held}", f"_inner{held}").drop("_c")
    tagged = tagged.persist()
    masks = [(F.col("_outer") != held) & (F.col(f"_inner{held}") != fold) for held in range(cv) for fold in range(inner_cv)] + [F.col("_outer") != held for held in range(cv)]
    counts = {bool(r["s"]): r for r in tagged.groupBy(second.alias("s")).agg(*(F.count(F.when(m, 1)).alias(f"n{i}") for i, m in enumerate(masks))).collect()}
    params = {f: {**DEFAULTS[f], **cfg.get(f, {})} for f in ("xgb", "lgbm", "lr")}
    runs = []
    for family in ("xgb", "lgbm"):
        for i, mask in enumerate(masks):
            sizes = {c: int(r[f"n{i}"]) for c, r in counts.items()}
            runs.append(Run(boost_spec(family, params[family], seed), F.when(mask, _boost_weight(family, params[family], second, sizes))))
    fitted = fit_boosters(tagged, feature_array(features), second.cast("double"), row_id, runs)
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        linear = list(pool.map(lambda m: fit_model(tagged.where(m), features, label, "lr", cfg.get("lr", {}), row_id, seed), masks))
    n, stacks, names = len(masks), [], ["_s0", "_s1", "_s2"]
    for held in range(cv):
        fold = F.col(f"_inner{held}")
        first = held * inner_cv
        by_fold = F.lit(None).cast("double")
        for i in range(inner_cv):
            by_fold = F.when(fold == i, _linear_probability(linear[first + i].model, features)).otherwise(by_fold)
        rest = tagged.where(F.col("_outer") != held)
        meta_rows = rest.select(
            row_id, label, _picked(fitted[first:first + inner_cv], fold, feature_array(features)).alias("_s0"),
            _picked(fitted[n + first:n + first + inner_cv], fold, feature_array(features)).alias("_s1"), by_fold.alias("_s2"))
        meta = fit_model(meta_rows, names, label, "lr", {"max_iter": 2000}, row_id, seed)
        at = cv * inner_cv + held
        bases = [FittedModel(f, params[f], features, [0.0, 1.0], m) for f, m in (("xgb", fitted[at]), ("lgbm", fitted[n + at]))]
        stack = _Stack([*bases, linear[at]], meta, None)
        scored = stack.raw(tagged.where(F.col("_outer") == held)).withColumn("_yy", F.col(label).cast("double"))
        stack.calibrator = IsotonicRegression(featuresCol="_meta", labelCol="_yy", predictionCol="_cal").fit(scored)
        stacks.append(stack)
    tagged.unpersist()
    return FittedModel("stacker", cfg, features, [0.0, 1.0], CalibratedStack(stacks))
