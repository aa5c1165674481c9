"""Bagged forests whose trees grow next to the rows, and trees that stay in files.

MLlib grows a forest by passes that take some nodes each; its driver holds every node as an object and draws for it. That suits small tables, and tables that
no task can hold. Between the two (:func:`tree_files.grows_here`) each task gets the binned rows, a byte or two a cell, and grows whole trees; the driver sees no node.

A tree is what MLlib grows: rows drawn with Poisson(1) copies, features drawn for every node, up to ``FOREST_BINS`` bins a feature with thresholds half way
between bins, the split that lowers variance or Gini impurity most, ``min_rows`` rows on both sides. Leaves of a classifier that vote for the same class are
joined where they meet, as MLlib joins them. Draws are digests of seed, tree, node and row, and sums are whole numbers, so neither partitions nor retries
matter; they are not the draws of MLlib.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from .boosting import BLOCK_ROWS, Grid, mixed, quantile_cuts
from .random_trees import child_keys, draws, root_key
from .tree_files import Grown, TreeFiles, cell_sums, dealt_trees, keep_trees

#: Bins of a feature, as many as MLlib's.
FOREST_BINS = 32
#: Cells (rows x features) of a node search, and cells (nodes x features) of a draw.
SEARCH_CELLS, DRAW_CELLS = 4_000_000, 2_000_000
#: Gains of impurity up to this share of a node's weight are none.
LEAST_GINI = 1e-13
#: Cumulated chances of 0, 1, 2 ... copies of a row.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def features_tried(strategy: str, n_features: int, n_trees: int, classes: int) -> int:
    """Features looked at for a node, by MLlib's names."""
    name = ("all" if n_trees == 1 else "sqrt" if classes else "onethird") if strategy == "auto" else strategy
    if name in ("all", "sqrt", "log2", "onethird"):
        return max(1, math.ceil({"all": n_features, "sqrt": math.sqrt(n_features), "log2": math.log2(n_features), "onethird": n_features / 3}[name]))
    return max(1, min(n_features, int(name) if name.isdigit() else math.ceil(float(name) * n_features)))


@dataclass(frozen=True)
class ForestSpec:
    """Settings of one forest; ``n_try`` features are looked at for a node, ``classes`` is 0 for numbers."""

    n_trees: int
    max_depth: int
    min_rows: int
    n_try: int
    classes: int = 0
    seed: int = 42


# ---- growing


def copy_counts(key: np.ndarray, spec: ForestSpec, tree: int) -> np.ndarray:
    """Copies of each row in a tree."""
    salt = mixed(np.array([spec.seed * 1_000_003 + tree], np.uint64))[0]
    u = (mixed(key ^ salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.searchsorted(POISSON, u, "right").astype(np.float64)


def told_apart(key: np.ndarray) -> np.ndarray:
    """Digests of rows; equal ones are numbered, so that equal rows are drawn each for itself."""
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]]) if len(key) else np.zeros(0, bool)
    place = np.arange(len(key))
    nth = place - np.maximum.accumulate(np.where(same, 0, place)) if len(key) else place
    out = np.empty_like(key)
    out[order] = mixed(key[order] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def drawn_features(keys: np.ndarray, n_features: int, n_try: int) -> np.ndarray:
    """The features looked at for each node, nodes x ``n_try``, ascending."""
    if n_try >= n_features:
        return np.tile(np.arange(n_features), (len(keys), 1))
    step, parts = max(1, DRAW_CELLS // n_features), []
    for low in range(0, len(keys), step):
        u = draws(keys[low:low + step], np.arange(n_features))
        parts.append(np.sort(np.argpartition(u, n_try - 1, axis=1)[:, :n_try], axis=1))
    return np.concatenate(parts)


def _best(bins: np.ndarray, width: int, rows: np.ndarray, slot: np.ndarray, asked: np.ndarray, weights: list[np.ndarray], totals: list[np.ndarray], spec: ForestSpec):
    """Best split of each slot: gain, feature, bin, and the sums of its left side."""
    n_open, n = len(asked), bins.shape[1]
    gain, feature, at = np.full(n_open, -np.inf), np.zeros(n_open, np.int64), np.zeros(n_open, np.int64)
    left = [np.zeros(n_open) for _ in weights]
    step, flat = max(1, SEARCH_CELLS // max(len(rows), 1)), bins.ravel()
    for low in range(0, asked.shape[1], step):
        part = asked[:, low:low + step]
        m = part.shape[1]
        b = np.take(flat, part[slot] * n + rows[:, None])
        cell = ((slot[:, None] * m + np.arange(m)) * width + b).ravel()
        cell, sums = cell_sums(cell, n_open * m * width, weights, m)
        group = cell // width
        first = np.concatenate([[True], group[1:] != group[:-1]])
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        side = []
        for s in sums:
            upto = np.cumsum(s)
            side.append(upto - (upto[starts] - s[starts])[run])
        own = group // m
        whole = [t[own] for t in totals]
        rest = [w - s for w, s in zip(whole, side)]
        fits = (side[0] >= spec.min_rows) & (rest[0] >= spec.min_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            if spec.classes:
                wl, wr, wt = sum(side[1:]), sum(rest[1:]), sum(whole[1:])
                g = sum(s * s for s in side[1:]) / wl + sum(s * s for s in rest[1:]) / wr - sum(s * s for s in whole[1:]) / wt
                fits &= (wl > 0) & (wr > 0)
                g = np.where(fits & (g > LEAST_GINI * wt), g, -np.inf)
            else:
                g = side[1] ** 2 / side[0] + rest[1] ** 2 / rest[0] - whole[1] ** 2 / whole[0]
                g = np.where(fits & (g > 0), g, -np.inf)
        begins = np.searchsorted(own, np.arange(n_open))
        top = np.maximum.reduceat(g, begins)
        hit = np.flatnonzero((g == top[own]) & (g > gain[own]))[::-1]
        pick = np.full(n_open, -1)
        pick[own[hit]] = hit
        s = np.flatnonzero(pick >= 0)
        k = pick[s]
        gain[s], feature[s], at[s] = g[k], part[s, group[k] - s * m], cell[k] % width
        for to, have in zip(left, side):
            to[s] = have[k]
    return gain, feature, at, left


def grown(bins: np.ndarray, sizes: np.ndarray, key: np.ndarray, stats: Sequence[np.ndarray], spec: ForestSpec, tree: int) -> Grown:
    """One tree. ``stats``: whole numbers of the rows, the target, or the weight in each class."""
    copies = copy_counts(key, spec, tree)
    rows = np.flatnonzero(copies)
    copies = copies[rows]
    weights = [copies, *(copies * s[rows] for s in stats)]
    width = int(sizes.max(initial=1))
    features, cuts, lefts, totals = [], [], [], []
    keys, slot = np.array([root_key(spec.seed, tree)], np.int64), np.zeros(len(rows), np.int64)
    level = [np.array([w.sum()]) for w in weights]
    made, depth = 1, 0
    while True:
        n_level = len(level[0])
        feature, cut, first = np.full(n_level, -1, np.int64), np.zeros(n_level, np.int64), np.zeros(n_level, np.int64)
        totals.append(level)
        features.append(feature), cuts.append(cut), lefts.append(first)
        wide = (level[0] >= 2 * spec.min_rows) & (depth < spec.max_depth)
        if spec.classes:
            wide &= np.max(level[1:], axis=0) < sum(level[1:])
        live = np.flatnonzero(wide)
        if not len(live):
            break
        small = np.full(n_level, -1)
        small[live] = np.arange(len(live))
        own = small[slot]
        stay = own >= 0
        rows, own = rows[stay], own[stay]
        weights = [w[stay] for w in weights]
        near, whole = weights, [t[live] for t in level]
        if not spec.classes:  # sums around the middle of each node lose nothing when they are squared
            middle = np.rint(whole[1] / whole[0])
            near = [weights[0], weights[1] - weights[0] * middle[own]]
            whole = [whole[0], whole[1] - whole[0] * middle]
        gain, best, at, left = _best(bins, width, rows, own, drawn_features(keys[live], len(sizes), spec.n_try), near, whole, spec)
        split = np.flatnonzero(gain > -np.inf)
        if not len(split):
            break
        if not spec.classes:
            left[1] = left[1] + left[0] * middle
        feature[live[split]], cut[live[split]] = best[split], at[split]
        first[live[split]] = made + 2 * np.arange(len(split))
        made += 2 * len(split)
        nth = np.full(len(live), -1)
        nth[split] = np.arange(len(split))
        goes = nth[own]
        stay = goes >= 0
        rows, own, goes = rows[stay], own[stay], goes[stay]
        weights = [w[stay] for w in weights]
        slot = 2 * goes + (np.take(bins.ravel(), best[own] * bins.shape[1] + rows) > at[own])
        pairs = [np.stack([a[split], t[live[split]] - a[split]], axis=1).ravel() for a, t in zip(left, level)]
        keys = np.stack(child_keys(keys[live[split]]), axis=1).ravel()
        level, depth = pairs, depth + 1
    totals = [np.concatenate([t[k] for t in totals]) for k in range(len(weights))]
    found = Grown(*map(np.concatenate, (features, cuts)), np.zeros(made, bool), np.concatenate(lefts), np.stack(totals[1:], axis=1), totals[0])
    return pruned(found) if spec.classes else found


def pruned(tree: Grown) -> Grown:
    """Without leaves that vote for the class of the leaf beside them."""
    vote = np.argmax(tree.value, axis=1)
    feature, left = tree.feature.copy(), tree.left
    while True:
        inner = np.flatnonzero(feature >= 0)
        a = left[inner]
        same = inner[(feature[a] < 0) & (feature[a + 1] < 0) & (vote[a] == vote[a + 1])]
        if not len(same):
            break
        feature[same] = -1
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for node in np.flatnonzero(feature >= 0):  # parents stand before their children
        if kept[node]:
            kept[left[node]] = kept[left[node] + 1] = True
    place = np.cumsum(kept) - 1
    return Grown(feature[kept], np.where(feature >= 0, tree.bin, 0)[kept], tree.missing_left[kept], np.where(feature >= 0, place[left], 0)[kept], tree.value[kept], tree.cover[kept])


def middle_cuts(rows: DataFrame, values: str, n_features: int, weight: str) -> list[np.ndarray]:
    """Thresholds of up to ``FOREST_BINS`` bins of each feature, half way between the last value of a bin and the first of the next."""
    edges, firsts = quantile_cuts(rows, values, n_features, weight, FOREST_BINS, firsts=True)
    return [np.append((a[:-1] + b[1:]) / 2, np.inf) if len(a) else a for a, b in zip(edges, firsts)]


def fit_forest(df: DataFrame, values: Column, target: Column, spec: ForestSpec, weight: Column | None = None) -> TreeFiles:
    """Fit one forest. ``values`` is an array of feature values without gaps, ``target`` a number or the number of a class, ``weight`` that of a row in its class."""
    spark = df.sparkSession
    rows = df.select(values.cast("array<double>").alias("x"), target.cast("double").alias("y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    rows = rows.where("y is not null").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("f"), F.max("w").alias("top"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
        n, n_features = facts["n"], max(facts["f"] or 0, 0)
        if not n or not n_features:
            raise ValueError("a forest needs rows and features")
        cuts = middle_cuts(rows.withColumn("_w", F.lit(1.0)), "x", n_features, "_w")
        grid = Grid(cuts)
        bits = 50 - (n * max(spec.n_try, 1)).bit_length()  # all sums are whole numbers below 2^53
        start = (facts["lo"] + facts["hi"]) / 2
        reach = max(facts["hi"] - start, start - facts["lo"]) or 1.0
        unit = 2.0**bits / ((facts["top"] or 1.0) if spec.classes else reach)

        def pack(batches):
            for batch in batches:
                for low in range(0, batch.num_rows, BLOCK_ROWS):
                    piece = batch.slice(low, BLOCK_ROWS)
                    x = piece["x"].flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, n_features)
                    y, w = (piece[c].to_numpy(zero_copy_only=False) for c in ("y", "w"))
                    stat = np.rint(w * unit) if spec.classes else np.rint((y - start) * unit)
                    kind = y if spec.classes else np.zeros(len(y))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([a.tobytes()], pa.binary()) for a in (grid.binned(x), kind.astype(np.uint16), stat, piece["key"].to_numpy().view(np.uint64))] + [pa.array([piece.num_rows])],
                        ["bins", "kind", "stat", "key", "n"])

        packed = rows.select("*", F.xxhash64("x", "y", "w").alias("key")).mapInArrow(pack, "bins binary, kind binary, stat binary, key binary, n long")
        sizes = grid.sizes

        def grow(blocks, trees):
            bins = np.ascontiguousarray(np.concatenate([np.frombuffer(b[0], grid.kind).reshape(n_features, b[4]) for b in blocks], axis=1))
            kind, stat, key = (np.concatenate([np.frombuffer(b[i], t) for b in blocks]) for i, t in ((1, np.uint16), (2, np.float64), (3, np.uint64)))
            del blocks
            order = np.argsort(key, kind="stable")
            bins, kind, stat, key = np.ascontiguousarray(bins[:, order]), kind[order], stat[order], told_apart(key[order])
            stats = [np.where(kind == c, stat, 0.0) for c in range(spec.classes)] if spec.classes else [stat]
            for tree in trees:
                yield grown(bins, sizes, key, stats, spec, tree).row(tree)

        path = keep_trees(spark, dealt_trees(packed.rdd.map(tuple), spec.n_trees, grow))
        return TreeFiles(path, spec.n_trees, cuts, spec.classes, 1.0 / unit, start)
    finally:
        rows.unpersist()
