"""Ranking and threshold metrics on a table of (keys..., label 0/1, score).

Scores are first counted per distinct value, which bounds the rows a curve
needs and lets ties be handled exactly; running totals then follow the
bucketed order, so no curve is computed in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import BUCKET, TARGET_ROWS, mid_ranks, running_totals, with_value_buckets


def _key_all(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    if by:
        return df, list(by), False
    return df.withColumn("_all", F.lit(1)), ["_all"], True


def _with_totals(counted: DataFrame, by: list[str], single: bool) -> DataFrame:
    totals = counted.groupBy(*by).agg(F.sum("tp").alias("pos"), F.sum("fp").alias("neg"))
    if single:
        row = totals.first()
        pos, neg = (row["pos"], row["neg"]) if row else (0, 0)
        return counted.withColumn("pos", F.lit(pos)).withColumn("neg", F.lit(neg))
    return counted.join(totals, by)


def score_counts(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col(label).cast("long")
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(y).alias("tp"), F.sum(1 - y).alias("fp"))


def curve_points(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """One row per distinct score with counts at (``tp``, ``fp``) and at-or-above (``ctp``, ``cfp``) it."""
    df, keys, single = _key_all(df, by)
    counted = score_counts(df, keys, label, score)
    placed = running_totals(counted, "score", {"ctp": "tp", "cfp": "fp"}, by=keys, descending=True, target_rows=target_rows)
    out = _with_totals(placed, keys, single)
    return out.drop("_all") if single else out


def pr_curve(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each threshold, from :func:`curve_points`."""
    return points.select(
        *by,
        F.col("score").alias("threshold"),
        F.coalesce(F.try_divide("ctp", F.col("ctp") + F.col("cfp")), F.lit(0.0)).alias("precision"),
        F.try_divide("ctp", "pos").alias("recall"),
    )


def roc_curve(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rates per threshold; the point (0, 0) has no finite threshold."""
    body = points.select(
        *by,
        F.try_divide("cfp", "neg").alias("fpr"),
        F.try_divide("ctp", "pos").alias("tpr"),
        F.col("score").cast("double").alias("threshold"),
    )
    start = (points.select(*by).distinct() if by else points.select(F.lit(1).alias("_one")).limit(1)).select(
        *by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold")
    )
    return start.unionByName(body)


def ranking_metrics(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under ROC (ties count half) and step-wise average precision."""
    fp, tp = F.col("fp").cast("double"), F.col("tp").cast("double")
    wins = fp * (F.col("ctp") - F.col("tp")) + tp * fp / 2.0
    step = tp * F.try_divide("ctp", F.col("ctp") + F.col("cfp"))
    sums = points.groupBy(*by).agg(
        F.sum(wins).alias("_wins"), F.sum(step).alias("_steps"), F.max("pos").alias("_pos"), F.max("neg").alias("_neg")
    )
    return sums.select(
        *by,
        F.try_divide("_wins", F.col("_pos").cast("double") * F.col("_neg")).alias("roc_auc"),
        F.try_divide("_steps", "_pos").alias("pr_auc"),
    )


def best_f_threshold(points: DataFrame, by: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    """Threshold with the highest F-beta; a tie takes the lowest threshold."""
    p = F.coalesce(F.try_divide("ctp", F.col("ctp") + F.col("cfp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("ctp", "pos"), F.lit(0.0))
    b2 = beta * beta
    f = (1 + b2) * p * r / F.greatest(b2 * p + r, F.lit(1e-12))
    scored = points.select(*by, "score", p.alias("precision"), r.alias("recall"), f.alias("f"))
    best = scored.groupBy(*by).agg(
        F.max_by(F.struct("score", "precision", "recall", "f"), F.struct(F.round("f", 12), -F.col("score"))).alias("b")
    )
    return best.select(
        *by,
        F.col("b.score").alias("threshold"),
        F.col("b.f").alias("f_score"),
        F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"),
    )


def recall_at_specificity(points: DataFrame, by: Sequence[str] = (), specificity: float = 0.90) -> DataFrame:
    """Highest recall whose specificity is met, at its highest threshold; (0, 0) has a missing threshold."""
    curve = roc_curve(points, by).where(1 - F.col("fpr") >= specificity)
    top = F.coalesce(F.col("threshold"), F.lit(float("inf")))
    best = curve.groupBy(*by).agg(F.max_by(F.struct("tpr", "threshold"), F.struct("tpr", top)).alias("b"))
    return best.select(*by, F.col("b.tpr").alias("recall_at_spec"), F.col("b.threshold").alias("threshold"))


def confusion(df: DataFrame, threshold, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Row counts per (label, prediction); every cell is present."""
    bound = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    hit = (F.col(score) >= bound).cast("int")
    y = F.col(label).cast("int")
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    wide = df.groupBy(*by).agg(*[F.count(F.when((y == a) & (hit == b), 1)).alias(f"c{a}{b}") for a, b in cells])
    packed = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"), F.col(f"c{a}{b}").alias("n")) for a, b in cells])
    return wide.select(*by, F.explode(packed).alias("c")).select(*by, "c.label", "c.pred", "c.n")


def classification_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means, from :func:`confusion`."""
    wide = cells.agg(*[
        F.sum(F.when((F.col("label") == a) & (F.col("pred") == b), F.col("n"))).alias(f"c{a}{b}")
        for a in (0, 1) for b in (0, 1)
    ])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    c = {k: F.col(k).cast("double") for k in ("c00", "c01", "c10", "c11")}

    def scores(hit, predicted, actual):
        p, r = zero(F.try_divide(hit, predicted)), zero(F.try_divide(hit, actual))
        return p, r, zero(F.try_divide(2 * p * r, p + r)), actual

    zero_class = scores(c["c00"], c["c00"] + c["c10"], c["c00"] + c["c01"])
    one_class = scores(c["c11"], c["c11"] + c["c01"], c["c11"] + c["c10"])
    total = zero_class[3] + one_class[3]
    accuracy = zero(F.try_divide(c["c00"] + c["c11"], total))
    macro = [(a + b) / 2 for a, b in zip(zero_class[:3], one_class[:3])]
    weighted = [zero(F.try_divide(a * zero_class[3] + b * one_class[3], total)) for a, b in zip(zero_class[:3], one_class[:3])]
    rows = {
        "0": zero_class,
        "1": one_class,
        "accuracy": (accuracy, accuracy, accuracy, total),
        "macro avg": (*macro, total),
        "weighted avg": (*weighted, total),
    }
    packed = F.array(*[
        F.struct(F.lit(k).alias("class"), v[0].alias("precision"), v[1].alias("recall"), v[2].alias("f1"),
                 v[3].cast("long").alias("support"))
        for k, v in rows.items()
    ])
    return wide.select(F.explode(packed).alias("r")).select("r.*")


def brier(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"))


def regression_errors(df: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """R squared, mean absolute error and root mean squared error."""
    e = F.col(y) - F.col(yhat)
    sums = df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("_mse"), F.var_pop(y).alias("_var")
    )
    return sums.select(*by, (1 - F.try_divide("_mse", "_var")).alias("r2"), "mae", F.sqrt("_mse").alias("rmse"))


def guarded_corr(a: str, b: str) -> Column:
    """Pearson correlation of the pairs that have both values; missing when either side is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def _attach_rank(df: DataFrame, ranks: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    table = ranks.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col(value).alias("_k_v"), F.col("mid_rank").alias(name))
    on = F.col(value) == F.col("_k_v")
    for k in by:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return df.join(table, on).drop("_k_v", *[f"_k_{k}" for k in by])


def spearman(df: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Pearson correlation of mid-ranks; undefined values become 0.

    Equal pairs are counted first, so a value held by many rows reaches the
    rank join once per distinct partner rather than once per row.
    """
    by = list(by)
    pairs = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    counted = pairs.groupBy(*by, y, yhat).agg(F.count(F.lit(1)).alias("_w"))
    ranked = _attach_rank(counted, mid_ranks(pairs, y, by), y, by, "_ra")
    ranked = _attach_rank(ranked, mid_ranks(pairs, yhat, by), yhat, by, "_rb")
    a, b, w = F.col("_ra"), F.col("_rb"), F.col("_w")
    sums = ranked.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"),
        F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"),
    )
    n = F.col("n").cast("double")
    cov = F.col("ab") - F.col("a") * F.col("b") / n
    va, vb = F.col("aa") - F.col("a") * F.col("a") / n, F.col("bb") - F.col("b") * F.col("b") / n
    return sums.select(*by, F.coalesce(F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)), F.lit(0.0)).alias("spearman"))


def trapezoid_area(curve: DataFrame, x: str = "fpr", y: str = "tpr", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Area under a curve given as points, by trapezoids between neighbours in order of ``x`` then ``y``.

    Points that share ``x`` add no area, so each distinct ``x`` keeps its
    lowest and highest ``y``.  Buckets of ``x`` are summed apart and linked by
    their edge points.
    """
    stacks = curve.groupBy(F.col(x).alias("_x")).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    bucketed, _ = with_value_buckets(stacks, "_x", target_rows)

    def strip(w):
        return (F.col("_x") - F.lag("_x").over(w)) * (F.col("_lo") + F.lag("_hi").over(w)) / 2.0

    inner = bucketed.withColumn("_s", strip(W.partitionBy(BUCKET).orderBy("_x"))).groupBy(BUCKET).agg(
        F.sum("_s").alias("_area"),
        F.min("_x").alias("_x0"),
        F.min_by("_lo", "_x").alias("_y0"),
        F.max("_x").alias("_x1"),
        F.max_by("_hi", "_x").alias("_y1"),
    )
    v = W.partitionBy(F.lit(0)).orderBy(BUCKET)
    link = (F.col("_x0") - F.lag("_x1").over(v)) * (F.col("_y0") + F.lag("_y1").over(v)) / 2.0
    return inner.withColumn("_l", link).agg(
        (F.coalesce(F.sum("_area"), F.lit(0.0)) + F.coalesce(F.sum("_l"), F.lit(0.0))).alias("area")
    )
