"""Outlier taming: detect, explain, repair.  Names, order and row count never change."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import clip, unit_scale
from .isolation import IsolationForest, fit_isolation_forest
from .quantiles import clean_numeric, group_quantiles, quantiles
from .schema import count_and_choose, numeric_columns
from .stats import safe_mad

DETECTORS = ("iforest", "cluster", "statistical")
REMEDIATIONS = ("winsorize", "percentile_clip", "mad_replace", "cluster_local_median", "shrink", "none")
MIN_DISTINCT = 10


@dataclass
class Clusters:
    """Centres with per-cluster medians; nearest centre and distance are plain expressions."""

    cols: list[str]
    centers: list[list[float]]
    threshold: float | None = None
    medians: dict[int, dict[str, float]] = field(default_factory=dict)

    def _distances(self) -> list[Column]:
        out = []
        for center in self.centers:
            total = F.lit(0.0)
            for c, v in zip(self.cols, center):
                total = total + (F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
            out.append(F.sqrt(total))
        return out

    def assign(self, df: DataFrame, distance: str = "score", cluster: str = "cluster") -> DataFrame:
        """Distance to the nearest centre and its number; a tie takes the lowest."""
        gaps = df.withColumn("_gaps", F.array(*self._distances()))
        return gaps.withColumns({
            distance: F.array_min("_gaps"),
            cluster: (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int"),
        }).drop("_gaps")

    def score(self, df: DataFrame, names: tuple[str, str, str] = ("score", "flag", "cluster")) -> DataFrame:
        score, flag, cluster = names
        return self.assign(df, score, cluster).withColumn(flag, (F.col(score) > F.lit(self.threshold)).cast("int"))

    def calibrate(self, df: DataFrame, contamination: float) -> "Clusters":
        """Distance threshold and cluster medians from the training rows."""
        placed = self.assign(df.select(*self.cols), "_d", "_c")
        self.threshold = quantiles(placed, {"t": (F.col("_d"), [1 - contamination])})["t"][0]
        rows = group_quantiles(placed, ["_c"], {c: (c, 0.5) for c in self.cols}).collect()
        self.medians = {r["_c"]: {c: r[c] for c in self.cols} for r in rows}
        return self


def fit_clusters(df: DataFrame, cols: Sequence[str], k: int, contamination: float, seed: int = 42) -> Clusters:
    cols = list(cols)
    vectors = VectorAssembler(inputCols=cols, outputCol="_v").transform(df.select(*cols)).select("_v").persist()
    try:
        model = KMeans(k=k, seed=seed, featuresCol="_v").fit(vectors)
    finally:
        vectors.unpersist()
    centers = sorted([float(v) for v in c] for c in model.clusterCenters())
    return Clusters(cols, centers).calibrate(df, contamination)


def feature_deviations(cols: Sequence[str], meds: dict, mads: dict) -> dict[str, Column]:
    return {c: (F.col(c) - F.lit(meds[c])) / F.lit(mads[c]) for c in cols}


def dominant_features(flagged: DataFrame, deviations: dict[str, Column], row_id: str, top_k: int = 3) -> DataFrame:
    """The ``top_k`` largest absolute deviations of each row, one output row each; no shuffle."""
    cells = F.array(*[
        F.struct((-F.abs(d)).alias("key"), F.lit(c).alias("feature"), d.alias("signed_mad_z")) for c, d in deviations.items()
    ])
    top = F.slice(F.array_sort(cells), 1, top_k)
    return flagged.select(F.col(row_id), F.posexplode(top).alias("pos", "e")).select(
        row_id, (F.col("pos") + 1).cast("int").alias("rank"), "e.feature", "e.signed_mad_z"
    )


def cluster_profile(df: DataFrame, deviations: dict[str, Column], cluster: str = "cluster", flag: str = "flag") -> DataFrame:
    """Mean absolute deviation per column, size and flag rate of each cluster."""
    return df.groupBy(cluster).agg(
        *[F.avg(F.abs(d)).alias(c) for c, d in deviations.items()],
        F.count(F.lit(1)).alias("n_members"),
        F.avg(F.col(flag).cast("double")).alias("flag_rate"),
    )


@dataclass
class TamerState:
    """Everything learned from the training rows."""

    cols: list[str]
    medians: dict[str, float]
    mads: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]
    detector: object = None
    clusters: Clusters | None = None
    score_bounds: tuple[float, float] | None = None


class OutlierTamer:
    """Configured by names of a detector and a remediation; ``fit`` returns self, ``transform`` is lazy."""

    def __init__(self, detector="iforest", remediation="winsorize", contamination=0.05, z_threshold=3.0, mad_threshold=3.5,
                 lower_quantile=0.01, upper_quantile=0.99, n_clusters=3, shrinkage_lambda=0.5, row_id="row_id", seed=42):
        if detector not in DETECTORS:
            raise ValueError(f"unknown detector: {detector!r}")
        if remediation not in REMEDIATIONS:
            raise ValueError(f"unknown remediation: {remediation!r}")
        self.detector, self.remediation, self.contamination = detector, remediation, contamination
        self.z_threshold, self.mad_threshold = z_threshold, mad_threshold
        self.lower_quantile, self.upper_quantile = lower_quantile, upper_quantile
        self.n_clusters, self.shrinkage_lambda, self.row_id, self.seed = n_clusters, shrinkage_lambda, row_id, seed
        self.state: TamerState | None = None

    def fit(self, df: DataFrame, cols: Sequence[str] | None = None) -> "OutlierTamer":
        cols = [c for c in (cols or numeric_columns(df)) if c != self.row_id]
        cols, counts, rows = count_and_choose(df, cols, MIN_DISTINCT)
        if not cols:
            self.state = TamerState([], {}, {}, {}, {})
            return self
        meds = {c: v[0] for c, v in quantiles(df, {c: (F.col(c), [0.5]) for c in cols}, counts=counts).items()}
        filled = self._fill(df, cols, meds)
        # Edges and deviations need the medians only, so one pass finds both.
        edges = {f"q:{c}": (F.col(c), [self.lower_quantile, self.upper_quantile]) for c in cols}
        spread = {f"m:{c}": (F.abs(F.col(c) - F.lit(meds[c])), [0.5]) for c in cols}
        found = quantiles(filled, {**edges, **spread}, counts=dict.fromkeys([*edges, *spread], rows))
        self.state = TamerState(
            cols, meds, {c: safe_mad(found[f"m:{c}"][0]) for c in cols},
            {c: found[f"q:{c}"][0] for c in cols}, {c: found[f"q:{c}"][1] for c in cols},
        )
        if self.detector == "cluster":
            self.state.detector = fit_clusters(filled, cols, self.n_clusters, self.contamination, self.seed)
        elif self.detector == "iforest":
            self.state.detector = fit_isolation_forest(filled, cols, self.row_id, self.contamination, seed=self.seed)
        if self.remediation == "cluster_local_median":
            self.state.clusters = (
                self.state.detector if self.detector == "cluster"
                else fit_clusters(filled, cols, self.n_clusters, self.contamination, self.seed)
            )
        if self.remediation == "shrink":
            self.state.score_bounds = self._bounds(self._score(filled))
        return self

    @staticmethod
    def _fill(df, cols, meds):
        return df.withColumns({c: F.coalesce(clean_numeric(F.col(c)), F.lit(meds[c])) for c in cols})

    @staticmethod
    def _bounds(scored):
        row = scored.agg(F.min("_t_score"), F.max("_t_score")).first()
        return row[0], row[1]

    def _score(self, filled: DataFrame, names: tuple[str, str, str] = ("_t_score", "_t_flag", "_t_cluster")) -> DataFrame:
        clash = set(names) & set(filled.columns)
        if clash:
            raise ValueError(f"columns would be overwritten: {sorted(clash)}")
        if self.detector == "statistical":
            worst = F.greatest(*[F.abs(d) for d in self.deviations().values()], F.lit(0.0))
            return filled.withColumn(names[0], worst).withColumn(names[1], (F.col(names[0]) > self.z_threshold).cast("int"))
        return self.state.detector.score(filled, names)

    def deviations(self) -> dict[str, Column]:
        """Robust z-score per column, for filled rows."""
        return feature_deviations(self.state.cols, self.state.medians, self.state.mads)

    def score(self, df: DataFrame) -> DataFrame:
        """Filled rows with ``score``, ``flag`` and, for the cluster detector, ``cluster``."""
        return self._score(self._fill(df, self.state.cols, self.state.medians), ("score", "flag", "cluster"))

    def explain(self, df: DataFrame, top_k: int = 3) -> DataFrame:
        return dominant_features(self.score(df).where("flag = 1"), self.deviations(), self.row_id, top_k)

    def transform(self, df: DataFrame, batch_bounds: bool = True) -> DataFrame:
        """Repaired rows.  ``shrink`` scales scores over this batch, or over fit-time bounds if told so (streams)."""
        st = self.state
        if not st.cols:
            return df
        filled = self._fill(df, st.cols, st.medians)
        dev = self.deviations()
        deviant = {c: F.abs(dev[c]) > F.lit(self.mad_threshold) for c in st.cols}
        x = {c: F.col(c) for c in st.cols}
        rem = self.remediation
        if rem == "none":
            return filled
        if rem == "winsorize":
            return filled.withColumns({
                c: F.when(deviant[c], clip(x[c], st.low[c], st.high[c])).otherwise(x[c]) for c in st.cols
            })
        if rem == "percentile_clip":
            return filled.withColumns({c: clip(x[c], st.low[c], st.high[c]) for c in st.cols})
        if rem == "mad_replace":
            return filled.withColumns({c: F.when(deviant[c], F.lit(st.medians[c])).otherwise(x[c]) for c in st.cols})
        if rem == "cluster_local_median":
            placed = st.clusters.assign(filled, "_d", "_c")
            local = {}
            for c in st.cols:
                med = F.lit(None).cast("double")
                for number, values in st.clusters.medians.items():
                    med = F.when(F.col("_c") == number, F.lit(values[c])).otherwise(med)
                local[c] = F.when(deviant[c], F.coalesce(med, x[c])).otherwise(x[c])
            return placed.withColumns(local).drop("_d", "_c")
        scored = self._score(filled)
        if batch_bounds and df.isStreaming:
            raise ValueError("shrink needs fit-time bounds on a stream: pass batch_bounds=False")
        low, high = self._bounds(scored) if batch_bounds else st.score_bounds
        lam = min(max(self.shrinkage_lambda, 0.0), 1.0)
        pull = F.lit(lam) * unit_scale(F.col("_t_score"), low, high)
        return scored.withColumns({c: x[c] - pull * (x[c] - F.lit(st.medians[c])) for c in st.cols}).select(*df.columns)
