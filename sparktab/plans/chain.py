"""Preparation and classification chain: impute, tame outliers, scale, select, balance (training only), classify."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import balance, impute, models, select
from ..operators.outlier import OutlierTamer, TamerState
from ..operators.scale import FITTERS

STEPS = ("imputer", "tamer", "normalizer", "selector", "balancer", "classifier")


@dataclass
class ChainConfig:
    """One candidate.  Options are ``name`` or ``name:number``, such as ``knn:5``, ``kbest:20`` or ``smote:3``."""

    imputer: str = "mean"
    normalizer: str = "zscore"
    detector: str = "iforest"
    remediation: str = "winsorize"
    contamination: float = 0.05
    mad_threshold: float = 3.5
    selector: str = "kbest:10"
    balancer: str = "identity"
    family: str = "lr"
    params: dict = field(default_factory=dict)


def _option(text: str, default: int) -> tuple[str, int]:
    name, _, number = text.partition(":")
    return name, int(number) if number else default


@dataclass
class OrderedFill:
    """Imputers that follow the row order and have nothing to learn."""

    kind: str
    row_id: str
    cols: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        if df.isStreaming:
            raise ValueError(f"{self.kind} needs the whole table in order and cannot run on a stream")
        run = {"ffill": impute.forward_fill, "bfill": impute.backward_fill, "interpolate": impute.interpolate}[self.kind]
        return run(df, self.row_id, self.cols)


def fit_imputer(df: DataFrame, cols: Sequence[str], label: str, row_id: str, option: str):
    name, k = _option(option, 5)
    fits: dict[str, Callable] = {
        "mean": lambda: impute.fit_mean(df, cols),
        "median": lambda: impute.fit_median(df, cols),
        "class_mean": lambda: impute.fit_class_mean(df, cols, label),
        "class_median": lambda: impute.fit_class_median(df, cols, label),
        "knn": lambda: impute.fit_knn(df, cols, row_id, k),
        "iterative": lambda: impute.fit_chained(df, cols),
        "model": lambda: impute.fit_regression(df, cols),
    }
    if name in ("ffill", "bfill", "interpolate"):
        return OrderedFill(name, row_id, list(cols))
    if name not in fits:
        raise ValueError(f"unknown imputer: {option!r}")
    return fits[name]()


def run_selector(df: DataFrame, cols: Sequence[str], label: str, option: str) -> list[str]:
    name, k = _option(option, 10)
    if name == "kbest":
        return select.select_k_best(df, cols, label, k)
    if name == "l1":
        return select.select_l1(df, cols, label)
    if name == "trees":
        return select.select_by_trees(df, cols, label)
    if name == "rfe":
        return select.select_recursively(df, cols, label, k)
    if name == "all":
        return list(cols)
    raise ValueError(f"unknown selector: {option!r}")


def run_balancer(df: DataFrame, cols: Sequence[str], label: str, row_id: str, option: str, seed: int = 42) -> DataFrame:
    name, k = _option(option, 3)
    if name == "identity":
        return df
    if name in ("undersample", "oversample"):
        return balance.SAMPLERS[name](df, label, row_id, seed)
    if name in ("smote", "adasyn", "borderline_smote"):
        return balance.SAMPLERS[name](df, list(cols), label, row_id, k, seed=seed)
    if name in ("smote_tomek", "smote_enn"):
        return balance.SAMPLERS[name](df, list(cols), label, row_id, seed=seed)
    raise ValueError(f"unknown balancer: {option!r}")


@dataclass
class FittedChain:
    """Fitted steps; scoring skips the balancer and never looks at the label."""

    config: ChainConfig
    features: list[str]
    row_id: str
    imputer: object
    tamer: OutlierTamer
    scaler: object
    selected: list[str]
    model: models.FittedModel

    def prepare(self, df: DataFrame, batch_bounds: bool = True) -> DataFrame:
        return self.scaler.transform(self.tamer.transform(self.imputer.transform(df), batch_bounds))

    def transform(self, df: DataFrame, batch_bounds: bool = True) -> DataFrame:
        """Add ``probability`` (array, one value per class)."""
        return self.model.transform(self.prepare(df, batch_bounds))

    def describe(self) -> list[tuple[str, str]]:
        c = self.config
        return [
            ("imputer", c.imputer), ("tamer", f"{c.detector}/{c.remediation}"), ("normalizer", c.normalizer),
            ("selector", f"{c.selector} -> {len(self.selected)} columns"), ("balancer", f"{c.balancer} (training only)"),
            ("classifier", c.family),
        ]


@dataclass
class FittedStart:
    """The first steps of a chain: the imputer, and what the tamer learned from the filled rows."""

    imputer: object
    state: TamerState


def start_key(config: ChainConfig) -> tuple:
    """What the first steps learn depends on; chains that agree in it can share a :class:`FittedStart`.

    Deviation limits, and the repairs that need only medians and edges, come in when rows are repaired.
    """
    local = config.remediation if config.remediation in ("cluster_local_median", "shrink") else None
    plain = config.detector == "statistical" and local != "cluster_local_median"
    return config.imputer, config.detector, local, None if plain else config.contamination


def _tamer(config: ChainConfig, row_id: str, seed: int) -> OutlierTamer:
    return OutlierTamer(config.detector, config.remediation, contamination=config.contamination, mad_threshold=config.mad_threshold, row_id=row_id, seed=seed)


def _filled(train: DataFrame, imputer) -> DataFrame:
    return imputer.transform_training(train) if isinstance(imputer, impute.ClassFill) else imputer.transform(train)


def fit_start(df: DataFrame, features: Sequence[str], label: str, row_id: str, config: ChainConfig, seed: int = 42) -> FittedStart:
    features = list(features)
    train = df.select(row_id, label, *features)
    imputer = fit_imputer(train, features, label, row_id, config.imputer)
    filled = _filled(train, imputer).persist()
    try:
        return FittedStart(imputer, _tamer(config, row_id, seed).fit(filled, features).state)
    finally:
        filled.unpersist()


def fit_chain(df: DataFrame, features: Sequence[str], label: str, row_id: str, config: ChainConfig, seed: int = 42, start: FittedStart | None = None) -> FittedChain:
    """Fit each step on the output of the one before; the tamed rows are kept for scaler, selector, balancer and model.

    ``start``: the first steps, where they were fitted on the same rows for a chain of the same :func:`start_key`.
    """
    features = list(features)
    train = df.select(row_id, label, *features)
    imputer = start.imputer if start else fit_imputer(train, features, label, row_id, config.imputer)
    filled = _filled(train, imputer)
    if start is None or config.remediation == "shrink":  # read more than once
        filled = filled.persist()
    try:
        tamer = _tamer(config, row_id, seed)
        if start is None:
            tamer.fit(filled, features)
        else:
            tamer.state = start.state
        if config.normalizer not in FITTERS:
            raise ValueError(f"unknown normalizer: {config.normalizer!r}")
        tamed = tamer.transform(filled).persist()
        try:
            scaler = FITTERS[config.normalizer](tamed, features)
            ready = scaler.transform(tamed)
            selected = run_selector(ready, features, label, config.selector)
            balanced = run_balancer(ready.select(row_id, label, *selected), selected, label, row_id, config.balancer, seed)
            model = models.fit_model(balanced, selected, label, config.family, config.params, row_id, seed)
        finally:
            tamed.unpersist()
    finally:
        filled.unpersist()
    return FittedChain(config, features, row_id, imputer, tamer, scaler, selected, model)
