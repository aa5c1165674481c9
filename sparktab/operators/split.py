"""Reproducible stratified folds and hold-outs, independent of how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordered import TARGET_ROWS, global_rank, hash_key


MANY_CLASSES = 20


def _shuffled_rank(df: DataFrame, label: str, row_id: str, seed, target_rows: int) -> DataFrame:
    keyed = df.withColumn("_h", hash_key(seed, row_id))
    few = _classes_are_few(df, label)
    return global_rank(keyed, "_h", "_r", by=[label], ties=[row_id], hashed=True, target_rows=target_rows, few_groups=few).drop("_h")


def _classes_are_few(df: DataFrame, label: str) -> bool:
    """At most MANY_CLASSES of them, counted; what is kept for each class and bucket can then be broadcast."""
    return df.select(label).distinct().limit(MANY_CLASSES + 1).count() <= MANY_CLASSES


def stratified_folds(
    df: DataFrame, label: str, row_id: str, n_folds: int = 5, seed=42, name: str = "fold", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Shuffle inside each class and deal the rows to folds, so sizes differ by at most one per class."""
    ranked = _shuffled_rank(df, label, row_id, seed, target_rows)
    return ranked.withColumn(name, ((F.col("_r") - 1) % n_folds).cast("int")).drop("_r")


def repeated_folds(df: DataFrame, label: str, row_id: str, n_folds: int = 5, n_repeats: int = 3, seed=42) -> DataFrame:
    """One fold column per repeat (``fold_0``, ``fold_1``, ...)."""
    for repeat in range(n_repeats):
        df = stratified_folds(df, label, row_id, n_folds, f"{seed}:{repeat}", f"fold_{repeat}")
    return df


def stratified_holdout(
    df: DataFrame, label: str, row_id: str, fraction: float = 0.2, seed=42, name: str = "is_holdout", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Mark the first ``fraction`` of each shuffled class."""
    ranked = _shuffled_rank(df, label, row_id, seed, target_rows)
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_size"))
    sizes = F.broadcast(sizes) if _classes_are_few(df, label) else sizes
    joined = ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    return joined.withColumn(name, F.col("_r") <= F.floor(F.col("_size") * fraction + 0.5)).drop("_r", "_size", "_label")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: rows, balanced weight ``n / (k * n_class)``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    total, classes = counts.agg(F.sum("n_rows"), F.count(F.lit(1))).first()
    return counts.withColumn("weight", F.lit(float(total or 0)) / (F.lit(classes) * F.col("n_rows")))


def positive_weight_base(df: DataFrame, label: str) -> float:
    """Negatives per positive."""
    row = df.agg(F.sum((F.col(label) == 0).cast("long")), F.sum((F.col(label) == 1).cast("long"))).first()
    return float(row[0] or 0) / max(float(row[1] or 0), 1.0)


def with_balanced_weight(df: DataFrame, label: str, name: str = "weight", counts: dict | None = None) -> DataFrame:
    """Weight column ``n / (k * n_class)`` as literals; the few classes are counted once, here or by the caller."""
    if counts is None:
        counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == F.lit(value), F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn(name, weight)
