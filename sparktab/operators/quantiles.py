"""Exact quantiles by linear interpolation, bounded in memory at any row count.

``percentile`` is exact but keeps every distinct value of a column in one
aggregation buffer.  It is used only while a checked number of values takes
part.  Past that, the sketch from ``percentile_approx`` brackets the wanted
ranks, one counting pass verifies the bracket, and the search repeats inside
it until what remains is small enough (or is a single value).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import running_totals

MAX_BUFFERED_VALUES = 200_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Bracket:
    """The closed value range that holds the order statistics ``lower_rank`` and ``lower_rank + 1``."""

    name: str
    prob: float
    lower_rank: int
    fraction: float
    low: float
    high: float
    below: int
    inside: int


def clean_numeric(col: Column) -> Column:
    """Double value with NaN read as missing."""
    value = col.cast("double")
    return F.when(~F.isnan(value), value)


def quantiles(
    df: DataFrame,
    requests: Mapping[str, tuple[Column, Sequence[float]]],
    max_values: int = MAX_BUFFERED_VALUES,
    counts: Mapping[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles of several expressions; ``requests`` maps a name to (expression, probabilities).

    ``counts`` gives the number of values per name where the caller has already counted them; it chooses the plan only.
    """
    if not requests:
        return {}
    names = list(requests)
    exprs = {n: clean_numeric(requests[n][0]) for n in names}
    probs = {n: [float(p) for p in requests[n][1]] for n in names}
    if counts is None:
        counted = df.agg(*[F.count(exprs[n]).alias(f"c{i}") for i, n in enumerate(names)]).first()
        counts = {n: counted[f"c{i}"] for i, n in enumerate(names)}

    small = [n for n in names if counts[n] <= max_values]
    result: dict[str, list[float | None]] = {}
    if small:
        row = df.agg(
            *[
                F.percentile(exprs[n], F.array(*map(F.lit, probs[n]))).alias(f"q{i}")
                for i, n in enumerate(small)
            ]
        ).first()
        for i, n in enumerate(small):
            result[n] = list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs[n])
    large = [n for n in names if counts[n] > max_values]
    if large:
        # A rank is only as good as its count: given counts are replaced by what the expressions hold.
        row = df.agg(*[F.count(exprs[n]).alias(f"c{i}") for i, n in enumerate(large)]).first()
        counts = {**counts, **{n: row[f"c{i}"] for i, n in enumerate(large)}}
        result.update(_bracketed(df, exprs, probs, counts, large, max_values))
    return {n: result[n] for n in names}


def _inside(exprs, b: _Bracket) -> Column:
    x = exprs[b.name]
    keep = F.lit(True)
    if math.isfinite(b.low):
        keep = keep & (x >= F.lit(b.low))
    if math.isfinite(b.high):
        keep = keep & (x <= F.lit(b.high))
    return F.when(keep, x)


def _bracketed(df, exprs, probs, counts, names, max_values):
    brackets = []
    for n in names:
        for p in probs[n]:
            position = p * (counts[n] - 1)
            lower = min(int(math.floor(position)), max(counts[n] - 2, 0))
            brackets.append(_Bracket(n, p, lower, position - lower, -math.inf, math.inf, 0, counts[n]))

    while True:
        open_ = [b for b in brackets if b.inside > max_values and b.low < b.high]
        if not open_:
            break
        _narrow(df, exprs, open_)

    pending = [b for b in brackets if b.low < b.high]
    values = {}
    if pending:
        row = df.agg(*[
            F.percentile(
                _inside(exprs, b),
                F.array(F.lit(_within(b.lower_rank - b.below, b.inside)), F.lit(_within(b.lower_rank + 1 - b.below, b.inside))),
            ).alias(f"v{i}")
            for i, b in enumerate(pending)
        ]).first()
        values = {id(b): row[f"v{i}"] for i, b in enumerate(pending)}
    finished: dict[str, list[float]] = {n: [] for n in names}
    for b in brackets:
        first, second = values.get(id(b), (b.low, b.low))
        finished[b.name].append(first + (second - first) * b.fraction)
    return finished


def _within(rank: int, size: int) -> float:
    return min(max(rank, 0), size - 1) / max(size - 1, 1)


def _narrow(df, exprs, brackets):
    """Shrink each bracket to sketch values around its ranks; one counting pass proves that the ranks stay inside."""
    slack = 4.0 / SKETCH_ACCURACY
    # Brackets that still cover the same values of a column share one sketch.
    shared: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        shared.setdefault((b.name, b.low, b.high), []).append(b)

    def edges(b: _Bracket) -> list[float]:
        first, second = _within(b.lower_rank - b.below, b.inside), _within(b.lower_rank + 1 - b.below, b.inside)
        return [max(0.0, first - slack), min(1.0, second + slack)]

    groups = list(shared.values())
    row = df.agg(*[
        F.percentile_approx(_inside(exprs, g[0]), [p for b in g for p in edges(b)], SKETCH_ACCURACY).alias(f"s{j}")
        for j, g in enumerate(groups)
    ]).first()
    sketched = [(b, row[f"s{j}"][2 * k], row[f"s{j}"][2 * k + 1]) for j, g in enumerate(groups) for k, b in enumerate(g)]
    counted = df.agg(
        *[F.count(F.when(exprs[b.name] < F.lit(low), 1)).alias(f"lt{i}") for i, (b, low, _) in enumerate(sketched)],
        *[F.count(F.when(exprs[b.name] <= F.lit(high), 1)).alias(f"le{i}") for i, (b, _, high) in enumerate(sketched)],
    ).first()
    for i, (b, low, high) in enumerate(sketched):
        below, upto = b.below, b.below + b.inside
        last_rank = b.lower_rank + (1 if b.fraction else 0)
        if counted[f"lt{i}"] <= b.lower_rank:
            b.low, below = low, counted[f"lt{i}"]
        if counted[f"le{i}"] > last_rank:
            b.high, upto = high, counted[f"le{i}"]
        shrunk = upto - below
        b.below = below
        if shrunk >= b.inside and b.low < b.high:
            _split_between_values(df, exprs, b)
        else:
            b.inside = shrunk


def _split_between_values(df, exprs, b: _Bracket):
    """The sketch made no headway: halve the value range, snapping the edges to existing values."""
    x = _inside(exprs, b)
    if not (math.isfinite(b.low) and math.isfinite(b.high)):
        b.low, b.high = df.agg(F.min(x), F.max(x)).first()
    middle = b.low + (b.high - b.low) / 2.0
    row = df.agg(
        F.count(F.when(x <= F.lit(middle), 1)).alias("left"), F.max(F.when(x <= F.lit(middle), x)).alias("left_max"),
        F.min(F.when(x > F.lit(middle), x)).alias("right_min"),
    ).first()
    first, second = b.lower_rank - b.below, b.lower_rank + (1 if b.fraction else 0) - b.below
    if second < row["left"]:
        b.high, b.inside = row["left_max"], row["left"]
    elif first >= row["left"]:
        b.low, b.below, b.inside = row["right_min"], b.below + row["left"], b.inside - row["left"]
    else:
        # The two ranks straddle the gap, so both order statistics are known.
        b.low = b.high = row["left_max"] + (row["right_min"] - row["left_max"]) * b.fraction
        b.inside = 1


def medians(df: DataFrame, cols: Sequence[str], max_values: int = MAX_BUFFERED_VALUES) -> dict[str, float | None]:
    """Exact median per column."""
    found = quantiles(df, {c: (F.col(c), [0.5]) for c in cols}, max_values)
    return {c: v[0] for c, v in found.items()}


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    requests: Mapping[str, tuple[str, float]],
    max_values: int = MAX_BUFFERED_VALUES,
) -> DataFrame:
    """Exact quantiles per group as a table; ``requests`` maps an output name to (column, probability).

    Groups small enough for one aggregation buffer use ``percentile``.  Where
    any group is larger, values are pre-counted and located by running totals,
    which spreads a hot group over many tasks.
    """
    by = list(by)
    biggest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if biggest <= max_values:
        return df.groupBy(*by).agg(
            *[
                F.percentile(clean_numeric(F.col(c)), F.lit(float(p))).alias(name)
                for name, (c, p) in requests.items()
            ]
        )
    out = df.select(*by).distinct()
    for name, (c, p) in requests.items():
        counted = (
            df.select(*by, clean_numeric(F.col(c)).alias("_v"))
            .where(F.col("_v").isNotNull())
            .groupBy(*by, "_v")
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        placed = running_totals(counted, "_v", {"_upto": "_n"}, by=by, target_rows=max_values)
        sizes = counted.groupBy(*by).agg(F.sum("_n").alias("_size"))
        position = (F.col("_size") - 1) * F.lit(float(p))
        lower = F.floor(position)
        start = F.col("_upto") - F.col("_n")
        holds = lambda rank: (rank >= start) & (rank < F.col("_upto"))
        upper = F.least(lower + 1, F.col("_size") - 1)
        picked = (
            placed.join(sizes, by)
            .where(holds(lower) | holds(upper))
            .groupBy(*by)
            .agg(
                F.max(F.when(holds(lower), F.col("_v"))).alias("_a"),
                F.max(F.when(holds(upper), F.col("_v"))).alias("_b"),
                F.max(position - lower).alias("_f"),
            )
            .select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(name))
        )
        out = out.join(picked, by, "left")
    return out
