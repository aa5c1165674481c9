"""Scoring bundle: raw rows in, label and confidence out; saved as a folder of small tables and MLlib models."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.classification import (
    LinearSVCModel, LogisticRegressionModel, MultilayerPerceptronClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import impute, models
from ..operators.boosting import Boosted
from ..operators.encode import encode_categories, expand_dates
from ..operators.isolation import IsolationForest
from ..operators.kernel_machine import KernelMachine
from ..operators.outlier import Clusters, OutlierTamer, TamerState
from ..operators.scale import LinearScale, PowerScale
from ..operators.schema import align_features, sanitize_columns
from ..operators.tree_files import TreeFiles
from .chain import ChainConfig, FittedChain, OrderedFill

_MODELS = {
    "lr": LogisticRegressionModel, "svc": LinearSVCModel, "rf": RandomForestClassificationModel, "mlp": MultilayerPerceptronClassificationModel,
}


@dataclass
class RawPreprocessor:
    """Raw rows to the training feature matrix: drop target, clean names, expand dates, code categories, align."""

    target: str
    calendars: dict[str, str]
    mapping: DataFrame
    features: list[str]
    name_mode: str = "full"

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        kept = df.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], "*")
        raw = kept.drop(self.target)
        names = [c for c in raw.columns if not c.startswith("_keep_")]
        clean = sanitize_columns(raw.select(*[F.col(f"`{c}`") for c in names]), self.target, self.name_mode).columns
        renamed = raw.toDF(*[c for c in raw.columns if c.startswith("_keep_")], *clean)
        dates = {c: k for c, k in self.calendars.items() if c in renamed.columns}
        expanded = expand_dates(renamed, dates)
        coded_cols = [r[0] for r in self.mapping.select("column").distinct().collect()]
        coded = encode_categories(expanded, self.mapping, [c for c in coded_cols if c in expanded.columns and c != self.target], "null")
        aligned = align_features(coded, self.features, [f"_keep_{i}" for i in range(len(keep))])
        return aligned.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], *self.features)


@dataclass
class Bundle:
    """Preprocessor, fitted chain, operating threshold and label names."""

    preprocessor: RawPreprocessor
    chain: FittedChain
    threshold: float = 0.5
    labels: dict[int, str] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    def predict_proba(self, raw: DataFrame, keep: tuple[str, ...] = (), batch_bounds: bool = True) -> DataFrame:
        kept = tuple(dict.fromkeys((self.chain.row_id, *keep))) if self.chain.row_id in raw.columns else keep
        ready = self.preprocessor.transform(raw, kept)
        if self.chain.row_id not in ready.columns:
            ready = ready.withColumn(self.chain.row_id, F.monotonically_increasing_id())
        scored = self.chain.transform(ready, batch_bounds)
        return scored.select(*[c for c in (self.chain.row_id, *keep) if c in scored.columns], "probability")

    def predict_labels(self, raw: DataFrame, keep: tuple[str, ...] = (), batch_bounds: bool = True) -> DataFrame:
        """``score``, ``prediction``, ``label`` and ``confidence`` from one probability computation."""
        return decide(self.predict_proba(raw, keep, batch_bounds), self.threshold, self.labels)

    def describe(self) -> list[tuple[str, str]]:
        return [*self.chain.describe(), ("threshold", f"{self.threshold:.4f}"), ("features", str(len(self.preprocessor.features)))]


def decide(scored: DataFrame, threshold: float, labels: dict[int, str]) -> DataFrame:
    """Threshold for two classes, largest probability otherwise; then decode, falling back to the code."""
    p = F.col("probability")
    top = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    prediction = F.when(F.size(p) == 2, (p[1] >= F.lit(threshold)).cast("int")).otherwise(top)
    out = scored.withColumn("score", F.when(F.size(p) == 2, p[1])).withColumn("prediction", prediction)
    return out.withColumn("label", decode_label(F.col("prediction"), labels)).withColumn("confidence", F.array_max(p))


def decode_label(code, labels: dict[int, str]):
    text = code.cast("string")
    if not labels:
        return text
    pairs = F.create_map(*[F.lit(v) for kv in labels.items() for v in (int(kv[0]), str(kv[1]))])
    return F.coalesce(F.try_element_at(pairs, code.cast("int")), text)


def scoring_report(decided: DataFrame, row_id: str) -> DataFrame:
    """Row, label and confidence."""
    return decided.select(row_id, "label", F.round("confidence", 4).alias("confidence"))


# ---- saving -----------------------------------------------------------------------------------


def _imputer_json(imp, path: str) -> dict:
    if isinstance(imp, impute.KnnFill):
        imp.donors.write.mode("overwrite").parquet(f"{path}/donors")
        return {"kind": "knn", "cols": imp.cols, "means": imp.means, "k": imp.k, "row_id": imp.row_id, "block_rows": imp.block_rows}
    if isinstance(imp, impute.ChainedFill):
        return {"kind": "chained", "cols": imp.cols, "fill": imp.fill.tolist(), "steps": [[j, b.tolist()] for j, b in imp.steps], "rounds": imp.rounds}
    kinds = {impute.ConstantFill: "constant", impute.ClassFill: "class", impute.RegressionFill: "regression", OrderedFill: "ordered"}
    return {"kind": kinds[type(imp)], **asdict(imp)}


def _imputer_from(spark: SparkSession, d: dict, path: str):
    d = dict(d)
    kind = d.pop("kind")
    if kind == "knn":
        return impute.KnnFill(spark.read.parquet(f"{path}/donors"), **d)
    if kind == "chained":
        return impute.ChainedFill(d["cols"], np.array(d["fill"]), [(j, np.array(b)) for j, b in d["steps"]], d["rounds"])
    if kind == "class":
        d["per_class"] = [tuple(p) for p in d["per_class"]]
    if kind == "regression":
        d["models"] = {c: (m[0], m[1]) for c, m in d["models"].items()}
    return {"constant": impute.ConstantFill, "class": impute.ClassFill, "regression": impute.RegressionFill, "ordered": OrderedFill}[kind](**d)


def _clusters_json(c: Clusters | None):
    return None if c is None else asdict(c)


def _clusters_from(d):
    return None if d is None else Clusters(d["cols"], d["centers"], d["threshold"], {int(k): v for k, v in d["medians"].items()})


def _tamer_json(t: OutlierTamer) -> dict:
    settings = {k: v for k, v in vars(t).items() if k != "state"}
    st = t.state
    state = {k: getattr(st, k) for k in ("cols", "medians", "mads", "low", "high", "score_bounds")}
    state["clusters"] = _clusters_json(st.clusters)
    if isinstance(st.detector, Clusters):
        state["detector"] = {"kind": "cluster", **_clusters_json(st.detector)}
    elif isinstance(st.detector, IsolationForest):
        f = st.detector
        state["detector"] = {"kind": "iforest", "cols": f.cols, "trees": [x.tolist() for x in f.trees], "sample_size": f.sample_size, "threshold": f.threshold}
    return {"settings": settings, "state": state}


def _tamer_from(d: dict) -> OutlierTamer:
    t = OutlierTamer(**d["settings"])
    s = dict(d["state"])
    det = s.pop("detector", None)
    s["clusters"] = _clusters_from(s["clusters"])
    s["score_bounds"] = tuple(s["score_bounds"]) if s["score_bounds"] else None
    t.state = TamerState(**s)
    if det and det["kind"] == "cluster":
        t.state.detector = _clusters_from(det)
    elif det:
        t.state.detector = IsolationForest(det["cols"], [np.array(x) for x in det["trees"]], det["sample_size"], det["threshold"])
    return t


def _save_model(m: models.FittedModel, path: str) -> dict:
    info = {"family": m.family, "params": m.params, "features": m.features, "classes": m.classes, "ignored": m.ignored,
            "extra": {k: v for k, v in m.extra.items() if k != "map"}}
    if m.family == "stacker":
        info["stacks"] = []
        for i, stack in enumerate(m.model.stacks):
            where = f"{path}/stack{i}"
            stack.calibrator.write().overwrite().save(f"{where}/calibrator")
            info["stacks"].append({"bases": [_save_model(b, f"{where}/base{j}") for j, b in enumerate(stack.bases)],
                                   "meta": _save_model(stack.meta, f"{where}/meta")})
    elif m.family in models.BOOSTED:
        info["trees"] = m.model.as_dict()
    elif isinstance(m.model, KernelMachine):
        info["machine"] = m.model.as_dict()
    elif isinstance(m.model, TreeFiles):
        info["forest"] = m.model.copied(f"{path}/trees").as_dict()
    else:
        m.model.write().overwrite().save(f"{path}/model")
    return info


def _load_model(d: dict, path: str) -> models.FittedModel:
    if d["family"] == "stacker":
        stacks = [
            models._Stack([_load_model(b, f"{path}/stack{i}/base{j}") for j, b in enumerate(s["bases"])],
                          _load_model(s["meta"], f"{path}/stack{i}/meta"), IsotonicRegressionModel.load(f"{path}/stack{i}/calibrator"))
            for i, s in enumerate(d["stacks"])
        ]
        return models.FittedModel("stacker", d["params"], d["features"], d["classes"], models.CalibratedStack(stacks))
    extra = dict(d["extra"])
    if d["family"] in models.BOOSTED:
        return models.FittedModel(d["family"], d["params"], d["features"], d["classes"], Boosted.from_dict(d["trees"]), extra, d["ignored"])
    if "machine" in d:
        return models.FittedModel(d["family"], d["params"], d["features"], d["classes"], KernelMachine.from_dict(d["machine"]), extra, d["ignored"])
    if "forest" in d:
        return models.FittedModel(d["family"], d["params"], d["features"], d["classes"], TreeFiles.from_dict(d["forest"], f"{path}/trees"), extra, d["ignored"])
    if d["family"] == "svc":
        extra["map"] = models.random_features(extra["dim"], extra["n_components"], extra["gamma"], extra["seed"])
    return models.FittedModel(d["family"], d["params"], d["features"], d["classes"], _MODELS[d["family"]].load(f"{path}/model"), extra, d["ignored"])


def save_bundle(bundle: Bundle, path: str) -> None:
    """Write everything scoring needs under one folder."""
    spark = bundle.preprocessor.mapping.sparkSession
    chain = bundle.chain
    scaler = chain.scaler
    state = {
        "threshold": bundle.threshold, "labels": bundle.labels, "metadata": bundle.metadata,
        "preprocessor": {"target": bundle.preprocessor.target, "calendars": bundle.preprocessor.calendars,
                         "features": bundle.preprocessor.features, "name_mode": bundle.preprocessor.name_mode},
        "chain": {
            "config": asdict(chain.config), "features": chain.features, "row_id": chain.row_id, "selected": chain.selected,
            "imputer": _imputer_json(chain.imputer, path), "tamer": _tamer_json(chain.tamer),
            "scaler": {"exponents": scaler.exponents, **asdict(scaler.linear)} if isinstance(scaler, PowerScale) else asdict(scaler),
            "model": _save_model(chain.model, f"{path}/classifier"),
        },
    }
    bundle.preprocessor.mapping.write.mode("overwrite").parquet(f"{path}/category_map")
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    state = json.loads(spark.read.text(f"{path}/state").first()[0])
    c = state["chain"]
    scaler = dict(c["scaler"])
    exponents = scaler.pop("exponents", None)
    linear = LinearScale(**scaler)
    chain = FittedChain(
        ChainConfig(**c["config"]), c["features"], c["row_id"], _imputer_from(spark, c["imputer"], path), _tamer_from(c["tamer"]),
        linear if exponents is None else PowerScale(exponents, linear), c["selected"], _load_model(c["model"], f"{path}/classifier"),
    )
    pre = RawPreprocessor(mapping=spark.read.parquet(f"{path}/category_map"), **state["preprocessor"])
    return Bundle(pre, chain, state["threshold"], {int(k): v for k, v in state["labels"].items()}, state["metadata"])
