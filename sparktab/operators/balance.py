"""Class balancing for training rows: neighbours are exact, every random choice is a hash of (seed, id, copy)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .neighbors import BLOCK_ROWS, knn_join
from .ordered import global_rank, hash_key


#: Rows that are broadcast to their copies; more rows have fewer copies each.
FEW_ROWS = 20_000


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


def _unit(seed, *parts: Column) -> Column:
    """Uniform [0, 1) value from a hash."""
    h = F.xxhash64(F.lit(str(seed)), *parts).bitwiseAND(F.lit((1 << 52) - 1))
    return h.cast("double") / F.lit(float(1 << 52))


def identity(df: DataFrame, *_args, **_kwargs) -> DataFrame:
    return df


def undersample(df: DataFrame, label: str, row_id: str, seed=42) -> DataFrame:
    """Keep as many hash-ordered rows of each class as the smallest class has."""
    fewest = min(class_counts(df, label).values())
    ranked = global_rank(df.withColumn("_h", hash_key(seed, row_id)), "_h", "_r", by=[label], ties=[row_id], hashed=True)
    return ranked.where(F.col("_r") <= fewest).drop("_h", "_r")


def _copies(df: DataFrame, label: str, row_id: str, seed, extra: dict) -> DataFrame:
    """Deal ``extra[class]`` draws evenly over the hash-ordered rows of each class: columns ``_r`` and ``_copy``."""
    ranked = global_rank(df.withColumn("_h", hash_key(seed, row_id)), "_h", "_r", by=[label], ties=[row_id], hashed=True)
    sizes = class_counts(df, label)
    times = F.lit(0).cast("long")
    for value, wanted in extra.items():
        n = sizes.get(value, 0)
        if n and wanted > 0:
            own = F.lit(wanted // n) + (F.col("_r") <= F.lit(wanted % n)).cast("long")
            times = F.when(F.col(label) == F.lit(value), own).otherwise(times)
    rows = sum(sizes.get(v, 0) for v, wanted in extra.items() if wanted > 0)
    if rows <= FEW_ROWS:
        # Few rows with many copies: a range of the wanted copies is spread over the cluster and looks its row up in a small table.
        drawn = None
        for value, wanted in extra.items():
            n = sizes.get(value, 0)
            if n and wanted > 0:
                i = df.sparkSession.range(wanted)
                own = i.select(F.lit(value).alias("_class"), (F.col("id") % n + 1).alias("_row"), (F.floor(F.col("id") / n) + 1).alias("_copy"))
                drawn = own if drawn is None else drawn.unionAll(own)
        if drawn is not None:
            chosen = ranked.where(F.col(label).isin([v for v, wanted in extra.items() if wanted > 0])).drop("_h")
            return drawn.join(F.broadcast(chosen), (F.col(label) == F.col("_class")) & (F.col("_r") == F.col("_row"))).select(*chosen.columns, "_copy")
    dealt = ranked.withColumn("_times", times).where("_times > 0")
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).drop("_h", "_times")


def _wanted(df: DataFrame, label: str) -> dict:
    counts = class_counts(df, label)
    most = max(counts.values())
    return {k: most - n for k, n in counts.items() if n < most}


def oversample(df: DataFrame, label: str, row_id: str, seed=42) -> DataFrame:
    """Raise every class to the largest one with copies of its own rows; ``is_synthetic`` marks the copies."""
    added = _copies(df, label, row_id, seed, _wanted(df, label)).drop("_r", "_copy")
    return df.withColumn("is_synthetic", F.lit(0)).unionByName(added.withColumn("is_synthetic", F.lit(1)))


def class_neighbours(df: DataFrame, cols: Sequence[str], label: str, row_id: str, k: int, classes, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """k nearest rows of the same class for each row of the listed classes."""
    found = None
    for value in classes:
        rows = df.where(F.col(label) == F.lit(value))
        near = knn_join(rows, rows, cols, k, row_id, row_id, block_rows=block_rows)
        found = near if found is None else found.unionByName(near)
    return found


def _interpolate(df: DataFrame, seeds: DataFrame, near: DataFrame, cols, label, row_id, seed, few: bool = False) -> DataFrame:
    """One synthetic row per (seed row, copy): a point between the row and one of its neighbours.

    ``few``: ``df`` and ``near`` come from at most FEW_ROWS rows; they are broadcast, so that no row gathers all its copies in one task.
    """
    small = F.broadcast if few else lambda rows: rows
    lists = small(near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))).alias("_near")))
    drawn = seeds.join(lists, F.col(row_id).cast("long") == F.col("query_id"))
    ident = F.col(row_id).cast("string")
    slot = F.floor(_unit(seed, F.lit("slot"), ident, F.col("_copy")) * F.size("_near")).cast("int")
    drawn = drawn.withColumn("_other", F.get("_near", slot)["neighbor_id"]).withColumn(
        "_u", _unit(seed, F.lit("step"), ident, F.col("_copy"))
    )
    other = small(df.select(F.col(row_id).cast("long").alias("_oid"), *[F.col(c).alias(f"_o_{c}") for c in cols]))
    joined = drawn.join(other, F.col("_other") == F.col("_oid"))
    return joined.select(
        F.col(row_id), F.col(label),
        *[(F.col(c) + F.col("_u") * (F.col(f"_o_{c}") - F.col(c))).alias(c) for c in cols],
        F.lit(1).alias("is_synthetic"), F.col("_other").alias("neighbor_id"), F.col("_copy").alias("copy"),
    )


def _with_original(df, cols, label, row_id, synthetic) -> DataFrame:
    original = df.select(row_id, label, *cols).withColumns({
        "is_synthetic": F.lit(0), "neighbor_id": F.lit(None).cast("long"), "copy": F.lit(None).cast("long"),
    })
    return original if synthetic is None else original.unionByName(synthetic)


def smote(df: DataFrame, cols: Sequence[str], label: str, row_id: str, k: int = 3, seed=42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Raise smaller classes with points between same-class neighbours; a class needs more than k rows."""
    counts, wanted = class_counts(df, label), _wanted(df, label)
    for value in wanted:
        if counts[value] <= k:
            raise ValueError(f"class {value!r} has {counts[value]} rows, which is not more than k={k}")
    if not wanted:
        return _with_original(df, cols, label, row_id, None)
    near = class_neighbours(df, cols, label, row_id, k, wanted, block_rows)
    seeds = _copies(df.select(row_id, label, *cols), label, row_id, seed, wanted)
    few = sum(counts[v] for v in wanted) <= FEW_ROWS
    own = df.where(F.col(label).isin(list(wanted))) if few else df  # neighbours are of the same class
    return _with_original(df, cols, label, row_id, _interpolate(own, seeds, near, cols, label, row_id, seed, few))


def majority_share(df: DataFrame, cols: Sequence[str], label: str, row_id: str, value, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, n_other, n_near)``: neighbours of another class among the k nearest of each row of one class."""
    rows = df.where(F.col(label) == F.lit(value))
    near = knn_join(rows, df, cols, k, row_id, row_id, block_rows=block_rows)
    labels = df.select(F.col(row_id).cast("long").alias("neighbor_id"), F.col(label).alias("_l"))
    return near.join(labels, "neighbor_id").groupBy("query_id").agg(
        F.sum((F.col("_l") != F.lit(value)).cast("long")).alias("n_other"), F.count(F.lit(1)).alias("n_near")
    )


def adasyn_quotas(df: DataFrame, cols: Sequence[str], label: str, row_id: str, value, k: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Synthetic rows per minority row: its share of foreign neighbours, normalised, times the shortfall, rounded half to even."""
    wanted = _wanted(df, label).get(value, 0)
    share = majority_share(df, cols, label, row_id, value, k, block_rows).withColumn("ratio", F.col("n_other") / F.lit(float(k)))
    total = share.agg(F.sum("ratio")).first()[0] or 0.0
    if total == 0.0:
        raise ValueError("no row of the class has a neighbour of another class")
    return share.select("query_id", "ratio", F.bround(F.col("ratio") / F.lit(total) * F.lit(float(wanted)), 0).cast("long").alias("quota"))


def adasyn(df: DataFrame, cols: Sequence[str], label: str, row_id: str, k: int = 3, seed=42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    wanted = _wanted(df, label)
    synthetic = None
    for value in wanted:
        rows = df.where(F.col(label) == F.lit(value)).select(row_id, label, *cols)
        quota = adasyn_quotas(df, cols, label, row_id, value, k, block_rows).where("quota > 0")
        seeds = rows.join(quota.select("query_id", "quota"), F.col(row_id).cast("long") == F.col("query_id")).drop("query_id")
        seeds = seeds.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota")))).drop("quota")
        near = class_neighbours(df, cols, label, row_id, k, [value], block_rows)
        made = _interpolate(df, seeds, near, cols, label, row_id, seed)
        synthetic = made if synthetic is None else synthetic.unionByName(made)
    return _with_original(df, cols, label, row_id, synthetic)


def danger_rows(df: DataFrame, cols: Sequence[str], label: str, row_id: str, value, m: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of a class with at least half, but not all, of their m neighbours in other classes."""
    share = majority_share(df, cols, label, row_id, value, m, block_rows)
    return share.where((F.col("n_other") * 2 >= m) & (F.col("n_other") < m)).select("query_id", "n_other")


def borderline_smote(df: DataFrame, cols: Sequence[str], label: str, row_id: str, k: int = 3, m: int = 10, seed=42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """SMOTE seeded by the danger rows only; a class without danger rows gains nothing."""
    wanted = _wanted(df, label)
    synthetic = None
    for value, n in wanted.items():
        danger = danger_rows(df, cols, label, row_id, value, m, block_rows).select(F.col("query_id").alias("_did"))
        rows = df.where(F.col(label) == F.lit(value)).select(row_id, label, *cols)
        seeds = rows.join(danger, F.col(row_id).cast("long") == F.col("_did"), "left_semi").persist()
        if not seeds.isEmpty():
            near = class_neighbours(df, cols, label, row_id, k, [value], block_rows)
            made = _interpolate(df, _copies(seeds, label, row_id, seed, {value: n}), near, cols, label, row_id, seed)
            synthetic = made if synthetic is None else synthetic.unionByName(made)
    return _with_original(df, cols, label, row_id, synthetic)


def tomek_links(df: DataFrame, cols: Sequence[str], label: str, row_id: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(left_id, right_id)``: mutual nearest rows of different classes, smaller id first."""
    near = knn_join(df, df, cols, 1, row_id, row_id, block_rows=block_rows).select("query_id", "neighbor_id").persist()
    back = near.select(F.col("query_id").alias("b"), F.col("neighbor_id").alias("a"))
    mutual = near.where("query_id < neighbor_id").join(back, (F.col("query_id") == F.col("a")) & (F.col("neighbor_id") == F.col("b")))
    classes = df.select(F.col(row_id).cast("long").alias("_id"), F.col(label).alias("_l"))
    left = classes.select(F.col("_id").alias("query_id"), F.col("_l").alias("_ll"))
    right = classes.select(F.col("_id").alias("neighbor_id"), F.col("_l").alias("_lr"))
    typed = mutual.select("query_id", "neighbor_id").join(left, "query_id").join(right, "neighbor_id")
    return typed.where("_ll <> _lr").select(F.col("query_id").alias("left_id"), F.col("neighbor_id").alias("right_id"))


def edited_out(df: DataFrame, cols: Sequence[str], label: str, row_id: str, k: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Ids of rows that have a neighbour of another class among their k nearest."""
    near = knn_join(df, df, cols, k, row_id, row_id, block_rows=block_rows)
    mine = df.select(F.col(row_id).cast("long").alias("query_id"), F.col(label).alias("_lq"))
    theirs = df.select(F.col(row_id).cast("long").alias("neighbor_id"), F.col(label).alias("_ln"))
    typed = near.join(mine, "query_id").join(theirs, "neighbor_id")
    return typed.groupBy("query_id").agg(F.max((F.col("_lq") != F.col("_ln")).cast("int")).alias("_bad")).where("_bad = 1").select("query_id")


def _renumbered(df: DataFrame, row_id: str, copies: DataFrame) -> DataFrame:
    """Give synthetic rows ids above the original ones so they can take part in a neighbour join."""
    top = df.agg(F.max(F.col(row_id).cast("long"))).first()[0] or 0
    made = copies.where("is_synthetic = 1").withColumn("_h", hash_key("id", row_id, "copy"))
    made = global_rank(made, "_h", "_n", ties=[row_id, "copy"], hashed=True)
    made = made.withColumn("new_id", F.lit(top) + F.col("_n")).drop("_h", "_n")
    return copies.where("is_synthetic = 0").withColumn("new_id", F.col(row_id).cast("long")).unionByName(made)


def smote_tomek(df: DataFrame, cols: Sequence[str], label: str, row_id: str, k: int = 5, seed=42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """SMOTE, then both ends of every Tomek link are removed."""
    grown = _renumbered(df, row_id, smote(df, cols, label, row_id, k, seed, block_rows)).persist()
    links = tomek_links(grown, cols, label, "new_id", block_rows)
    ends = links.select(F.explode(F.array("left_id", "right_id")).alias("_end"))
    return grown.join(ends, F.col("new_id") == F.col("_end"), "left_anti")


def smote_enn(df: DataFrame, cols: Sequence[str], label: str, row_id: str, k: int = 5, k_edit: int = 3, seed=42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """SMOTE, then rows are kept only if their nearest rows all share their class."""
    grown = _renumbered(df, row_id, smote(df, cols, label, row_id, k, seed, block_rows)).persist()
    gone = edited_out(grown, cols, label, "new_id", k_edit, block_rows).select(F.col("query_id").alias("_gone"))
    return grown.join(gone, F.col("new_id") == F.col("_gone"), "left_anti")


SAMPLERS = {
    "identity": identity, "oversample": oversample, "undersample": undersample, "smote": smote, "adasyn": adasyn,
    "borderline_smote": borderline_smote, "smote_tomek": smote_tomek, "smote_enn": smote_enn,
}
