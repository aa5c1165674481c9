"""Order-dependent operators that never sort a whole table, or a hot group, in one task.

Rows are cut into buckets that follow the order key.  Inside a bucket a plain
window does the work; a table with one row per (group, bucket) carries what
earlier or later buckets contribute.  Bucket edges are values, so the layout
does not depend on how the input happens to be partitioned and a lost task can
be recomputed safely.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

TARGET_ROWS = 2_000_000
MAX_BUCKETS = 10_000
BUCKET = "_bucket"


def _bucket_count(df: DataFrame, target_rows: int) -> int:
    rows = df.count()
    return max(1, min(MAX_BUCKETS, math.ceil(rows / max(target_rows, 1))))


def _sort_key(col_name: str, df: DataFrame) -> Column:
    kind = dict(df.dtypes)[col_name]
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(col_name).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(F.col(col_name)).cast("double")
    return F.col(col_name).cast("double")


def with_value_buckets(df: DataFrame, order_col: str, target_rows: int = TARGET_ROWS) -> tuple[DataFrame, int]:
    """Add a bucket number that rises with ``order_col`` (number, date or timestamp)."""
    n = _bucket_count(df, target_rows)
    if n == 1:
        return df.withColumn(BUCKET, F.lit(0)), 1
    keyed = df.withColumn("_key", _sort_key(order_col, df))
    edges = keyed.agg(
        F.percentile_approx("_key", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("e")
    ).first()["e"]
    splits = [-math.inf, *sorted(set(edges or [])), math.inf]
    bucketed = Bucketizer(splits=splits, inputCol="_key", outputCol=BUCKET, handleInvalid="keep").transform(keyed)
    return bucketed.withColumn(BUCKET, F.col(BUCKET).cast("int")).drop("_key"), len(splits) - 1


def with_hash_buckets(df: DataFrame, hash_col: str, target_rows: int = TARGET_ROWS) -> tuple[DataFrame, int]:
    """Add a bucket number that rises with a hexadecimal digest column."""
    n = _bucket_count(df, target_rows)
    if n == 1:
        return df.withColumn(BUCKET, F.lit(0)), 1
    prefix = F.conv(F.substring(hash_col, 1, 6), 16, 10).cast("long")
    return df.withColumn(BUCKET, F.floor(prefix * n / float(16**6)).cast("int")), n


def hash_key(seed, *cols) -> Column:
    """Digest used wherever a reproducible shuffle order is needed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def _carry(df: DataFrame, n: int, by: list[str], aggs: list[Column]) -> DataFrame:
    return df.groupBy(*by, BUCKET).agg(*aggs)


def _join_carry(df: DataFrame, carry: DataFrame, by: list[str], few_groups: bool = False) -> DataFrame:
    keys = [*by, BUCKET]
    renamed = carry.select(*[F.col(k).alias(f"_c_{k}") for k in keys], *[c for c in carry.columns if c not in keys])
    condition = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        condition = part if condition is None else condition & part
    # Without groups there is a row for each bucket, MAX_BUCKETS at most; few groups are the caller's word, given after a count.
    renamed = F.broadcast(renamed) if few_groups or not by else renamed
    return df.join(renamed, condition, "left").drop(*[f"_c_{k}" for k in keys])


def global_rank(
    df: DataFrame,
    order_col: str,
    name: str = "rank",
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    descending: bool = False,
    hashed: bool = False,
    target_rows: int = TARGET_ROWS,
    few_groups: bool = False,
) -> DataFrame:
    """1-based row number of each row in its group, ordered by ``order_col`` then ``ties``.

    The order column should be close to unique (an id, a digest, a distinct
    value).  ``hashed`` says that it holds digests made by :func:`hash_key`,
    ``few_groups`` that the groups were counted and their bucket totals can be broadcast.
    """
    by = list(by)
    bucketed, n = (with_hash_buckets if hashed else with_value_buckets)(df, order_col, target_rows)
    if descending:
        bucketed = bucketed.withColumn(BUCKET, F.lit(n - 1) - F.col(BUCKET))
    first = F.col(order_col).desc() if descending else F.col(order_col).asc()
    local = F.row_number().over(W.partitionBy(*by, BUCKET).orderBy(first, *[F.col(t) for t in ties]))
    if n == 1:
        return bucketed.withColumn(name, local.cast("long")).drop(BUCKET)
    sizes = _carry(bucketed, n, by, [F.count(F.lit(1)).alias("_rows")])
    earlier = W.partitionBy(*by).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, BUCKET, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    return (
        _join_carry(bucketed, offsets, by, few_groups)
        .withColumn(name, (local + F.col("_offset")).cast("long"))
        .drop(BUCKET, "_offset")
    )


def running_totals(
    df: DataFrame,
    order_col: str,
    sums: Mapping[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Running sums up to and including each row; ``sums`` maps an output name to a column.

    ``order_col`` must be unique inside a group: pre-aggregate ties first.
    """
    by = list(by)
    bucketed, n = with_value_buckets(df, order_col, target_rows)
    if descending:
        bucketed = bucketed.withColumn(BUCKET, F.lit(n - 1) - F.col(BUCKET))
    key = F.col(order_col).desc() if descending else F.col(order_col).asc()
    upto = W.partitionBy(*by, BUCKET).orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    if n == 1:
        return bucketed.select("*", *[F.sum(c).over(upto).alias(o) for o, c in sums.items()]).drop(BUCKET)
    parts = _carry(bucketed, n, by, [F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
    earlier = W.partitionBy(*by).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *by, BUCKET, *[F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}") for o in sums]
    )
    joined = _join_carry(bucketed, offsets, by)
    return joined.select(
        *df.columns, *[(F.sum(c).over(upto) + F.col(f"_o_{o}")).alias(o) for o, c in sums.items()]
    )


def neighbours_in_order(
    df: DataFrame,
    order_col: str,
    cols: Sequence[str],
    by: Sequence[str] = (),
    position_col: str | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """For each column add the nearest filled value at-or-before (``_p_``) and at-or-after (``_n_``) each row.

    Both are structs ``(at, v)`` where ``at`` is ``position_col`` (default: the order column).
    """
    by = list(by)
    at = position_col or order_col
    bucketed, n = with_value_buckets(df, order_col, target_rows)

    def point(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("at"), F.col(c).alias("v")))

    back = W.partitionBy(*by, BUCKET).orderBy(order_col).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*by, BUCKET).orderBy(order_col).rowsBetween(0, W.unboundedFollowing)
    near = lambda c: (F.last(point(c), True).over(back), F.first(point(c), True).over(ahead))
    if n == 1:
        out = bucketed.select("*", *[near(c)[0].alias(f"_p_{c}") for c in cols], *[near(c)[1].alias(f"_n_{c}") for c in cols])
        return out.drop(BUCKET)
    edges = bucketed.groupBy(*by, BUCKET).agg(
        *[F.max_by(point(c), F.when(F.col(c).isNotNull(), F.col(order_col))).alias(f"_l_{c}") for c in cols],
        *[F.min_by(point(c), F.when(F.col(c).isNotNull(), F.col(order_col))).alias(f"_f_{c}") for c in cols],
    )
    before = W.partitionBy(*by).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*by).orderBy(BUCKET).rowsBetween(1, W.unboundedFollowing)
    carried = edges.select(
        *by,
        BUCKET,
        *[F.last(f"_l_{c}", True).over(before).alias(f"_cp_{c}") for c in cols],
        *[F.first(f"_f_{c}", True).over(after).alias(f"_cn_{c}") for c in cols],
    )
    joined = _join_carry(bucketed, carried, by)
    return joined.select(
        *df.columns,
        *[F.coalesce(near(c)[0], F.col(f"_cp_{c}")).alias(f"_p_{c}") for c in cols],
        *[F.coalesce(near(c)[1], F.col(f"_cn_{c}")).alias(f"_n_{c}") for c in cols],
    )


def mid_ranks(df: DataFrame, value_col: str, by: Sequence[str] = (), name: str = "mid_rank") -> DataFrame:
    """Average rank of every distinct value (1-based, ties share the mean rank) with its row count ``n``."""
    by = list(by)
    counted = df.groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counted, value_col, {"_upto": "n"}, by=by)
    return placed.select(*by, value_col, "n", (F.col("_upto") - (F.col("n") - 1) / 2.0).alias(name))
