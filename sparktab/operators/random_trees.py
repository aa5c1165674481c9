"""Regression trees with random thresholds, all trees of all models at once.

Every row takes part in every tree. For each node and feature a threshold is drawn evenly between the smallest and the largest value in the node; the
feature whose threshold gains most splits the node. The draw is a digest of seed, tree, path and feature, so a retry draws the same.

One aggregate serves a level: the histogram of a node tells the ends of its values and the sums below any threshold. Thresholds therefore fall between the
bins of :mod:`boosting`: exact for features of at most ``max_bins`` values, at bin edges beyond. Sums are whole numbers and don't depend on partitioning.

- Nodes wait in a line; at most ``OPEN_CELLS`` histogram cells of a tree and ``PASS_CELLS`` of a pass are asked for, so memory is bounded for any depth.
- A model has up to one leaf per ``min_rows`` rows and tree; on large tables ``max_depth`` or ``min_rows`` bound it.
- Missing values go to the side where they gain more, to the right where training saw none. A feature without two values in a node doesn't split it.
- A table of one partition of blocks is grown tree by tree, trees dealt over the tasks. Where asked for, trees of many rows are grown from the cells that hold
  rows alone (:func:`grown_at_random`, the same trees) and stay in files.

The result is a :class:`boosting.Boosted` whose trees carry their share of the mean: its score is the mean over the trees.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .boosting import MAX_BINS, PART_CELLS, Ask, Boosted, BoostSpec, Grid, Grower, Rule, Run, one_pass, n_parts, packed_blocks, quantile_cuts, side_by_side, slopes, taken, worth
from .tree_files import Grown, TreeFiles, cell_sums, dealt_trees, grows_here, keep_trees

OPEN_CELLS, PASS_CELLS = 1_000_000, 4_000_000
#: Gains up to this share of the squared range of the target are none.
LEAST_SHARE = 1e-12
PRIME = 2_147_483_647


def random_spec(n_trees: int = 100, max_depth: int = 30, min_rows: int = 1, seed: int = 42) -> BoostSpec:
    """Settings of one model: every tree has an equal share of the score."""
    return BoostSpec(n_trees, 1.0 / n_trees, "random", max_depth, 0, 0.0, 0.0, 0.0, 0.0, min_rows, 1.0, 1.0, "squared", None, seed)


def root_key(seed: int, tree: int) -> int:
    return ((seed * 1_000_003 + tree) % PRIME * 48_271 + 11) % PRIME


def child_keys(key: int) -> tuple[int, int]:
    return (key * 69_621 + 17) % PRIME, (key * 69_621 + 29) % PRIME


def draws(keys: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1), nodes x features; all products are below 2^63."""
    h = (keys[:, None] * 48_271 + features[None, :] + 1) % PRIME
    h = (h ^ (h >> 15)) * 69_621 % PRIME
    h = (h ^ (h >> 13)) * 48_271 % PRIME
    return h / PRIME


@dataclass
class Draw(Rule):
    """A rule that judges one drawn threshold for each node and feature."""

    keys: np.ndarray
    cuts: list[np.ndarray]


def drawn_splits(sums: np.ndarray, low: int, high: int, sizes: np.ndarray, rule: Draw) -> list[tuple]:
    """Best drawn split of each slot within the features low .. high - 1, in the form of :func:`boosting.best_splits`."""
    spec, (gs, hs) = rule.spec, rule.scales
    own = sizes[low:high]
    stops = np.cumsum(own)
    starts = stops - own
    filled = sums[..., 2] > 0
    filled[:, stops - 1] = False
    place = np.arange(sums.shape[1])
    first = np.minimum.reduceat(np.where(filled, place, sums.shape[1]), starts, axis=1)
    last = np.maximum.reduceat(np.where(filled, place, -1), starts, axis=1)
    wide = last > first
    u = draws(rule.keys, np.arange(low, high))
    at = np.zeros(first.shape, np.int64) + starts
    for j in np.flatnonzero(wide.any(axis=0)):
        s, cuts = np.flatnonzero(wide[:, j]), rule.cuts[low + j]
        a, b = first[s, j] - starts[j], last[s, j] - starts[j]
        drawn = cuts[a] + u[s, j] * (cuts[b] - cuts[a])
        at[s, j] += np.clip(np.searchsorted(cuts, drawn, "right") - 1, a, b - 1)
    total = sums[:, :stops[0]].sum(axis=1)
    upto = np.cumsum(sums, axis=1)
    before = np.where(starts[None, :, None] > 0, upto[:, np.maximum(starts - 1, 0)], 0)
    left = np.take_along_axis(upto, at[..., None], axis=1) - before
    missing = sums[:, stops - 1]
    usable = wide if rule.columns is None else wide & np.isin(np.arange(low, high), rule.columns)
    parent = worth(total[:, 0] / gs, total[:, 1] / hs, spec)
    gains = []
    for side in (left, left + missing):
        rest = total[:, None] - side
        gain = worth(side[..., 0] / gs, side[..., 1] / hs, spec) + worth(rest[..., 0] / gs, rest[..., 1] / hs, spec) - parent[:, None]
        fits = usable & (side[..., 2] >= max(spec.min_rows, 1)) & (rest[..., 2] >= max(spec.min_rows, 1))
        gains.append(np.where(fits, gain, -np.inf))
    to_left = gains[1] > gains[0]
    gain = np.where(to_left, gains[1], gains[0])
    out = []
    for s, j in enumerate(np.argmax(gain, axis=1)):
        side = left[s, j] + (missing[s, j] if to_left[s, j] else 0)
        out.append((float(gain[s, j]), low + int(j), int(at[s, j] - starts[j]), bool(to_left[s, j]), tuple(int(v) for v in side), tuple(int(v) for v in total[s])))
    return out


class RandomGrower(Grower):
    """One tree of a model; nodes that may still be split stand in a line."""

    def __init__(self, spec: BoostSpec, tree: int, n_features: int, start: float, scales: tuple[float, float], cuts: list[np.ndarray]):
        self.number, self.keys, self.line = tree, [root_key(spec.seed, tree)], []
        self.most = max(1, OPEN_CELLS // sum(len(c) + 1 for c in cuts))
        self.least = LEAST_SHARE * (scales[1] / scales[0]) ** 2
        super().__init__(replace(spec, rounds=1), n_features, start, scales, cuts)

    def salt(self, what: int) -> int:
        return root_key(self.spec.seed + what + 1, self.number)

    def rule(self) -> Draw:
        return Draw(self.spec, self.scales, self.columns, np.array([self.keys[n] for n in self.open], np.int64), self.cuts)

    def good(self, gain: float) -> bool:
        return gain > self.least

    def told(self, splits: list[tuple]) -> bool:
        if self.open == [0]:
            total = splits[0][5]
            self.tree.grad[0], self.tree.hess[0], self.tree.rows[0] = total[0] / self.scales[0], total[1] / self.scales[1], total[2]
        for node, found in zip(self.open, splits):
            if self.good(found[0]):
                pair = self.split(node, found)
                self.keys += child_keys(self.keys[node])
                if self.tree.depth[node] + 1 < self.spec.max_depth:
                    self.line += [p for p in pair if self.tree.rows[p] >= 2 * max(self.spec.min_rows, 1)]
        self.open, self.line = self.line[:self.most], self.line[self.most:]
        if not self.open:
            self.finish()
        return self.tree is None


#: Cells (rows x features) summed at a time.
SUM_CELLS = 4_000_000


def _searched(bins: np.ndarray, sizes: np.ndarray, rows: np.ndarray, slot: np.ndarray, keys: np.ndarray, sums: list[np.ndarray], total: list[np.ndarray], rule: Rule, cuts):
    """What :func:`drawn_splits` finds for each slot, from the cells that hold rows: gain, feature, bin, missing left, and the sums of the left side."""
    spec, (gs, hs), n_open, n = rule.spec, rule.scales, len(keys), bins.shape[1]
    best, feature, at = np.full(n_open, -np.inf), np.zeros(n_open, np.int64), np.zeros(n_open, np.int64)
    to_left, left = np.zeros(n_open, bool), [np.zeros(n_open) for _ in sums]
    parent = worth(total[1] / gs, total[2] / hs, spec)
    width, flat, step = int(sizes.max()), bins.ravel(), max(1, SUM_CELLS // len(rows))
    for low in range(0, len(sizes), step):
        part = np.arange(low, min(low + step, len(sizes)))
        m = len(part)
        cell = ((slot[:, None] * m + np.arange(m)) * width + np.take(flat, part * n + rows[:, None])).ravel()
        cell, found = cell_sums(cell, n_open * m * width, sums, m)
        group, bin_ = cell // width, cell % width
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))  # every group has rows
        last = np.append(first[1:], len(cell)) - 1
        own = np.tile(part, n_open)
        gap = bin_[last] == sizes[own] - 1
        a, b = bin_[first], bin_[np.maximum(last - gap, first)]
        wide = (last - gap >= first) & (b > a)
        k = np.flatnonzero(wide)
        u = draws(keys, part).ravel()[k]
        place = np.zeros(len(k), np.int64)
        for j in part.tolist():
            here = np.flatnonzero(own[k] == j)
            if len(here):
                i, c = k[here], cuts[j]
                drawn = c[a[i]] + u[here] * (c[b[i]] - c[a[i]])
                place[here] = np.clip(np.searchsorted(c, drawn, "right") - 1, a[i], b[i] - 1)
        end = np.searchsorted(cell, k * width + place, "right") - 1
        side, missing, whole = [], [], [t[k // m] for t in total]
        for v in found:
            upto = np.cumsum(v)
            side.append(upto[end] - (upto[first[k]] - v[first[k]]))
            missing.append(np.where(gap[k], v[last[k]], 0.0))
        gains = []
        for some in (side, [x + y for x, y in zip(side, missing)]):
            rest = [w - x for w, x in zip(whole, some)]
            gain = worth(some[1] / gs, some[2] / hs, spec) + worth(rest[1] / gs, rest[2] / hs, spec) - parent[k // m]
            gains.append(np.where((some[0] >= max(spec.min_rows, 1)) & (rest[0] >= max(spec.min_rows, 1)), gain, -np.inf))
        other = gains[1] > gains[0]
        gain = np.full((n_open, m), -np.inf)
        gain.ravel()[k] = np.where(other, gains[1], gains[0])
        nth = np.zeros(n_open * m, np.int64)
        nth[k] = np.arange(len(k))
        top = np.argmax(gain, axis=1)
        line = np.arange(n_open)
        s = np.flatnonzero(gain[line, top] > best)
        pick = nth[s * m + top[s]]
        best[s], feature[s], at[s], to_left[s] = gain[s, top[s]], part[top[s]], place[pick], other[pick]
        for to, x, y in zip(left, side, missing):
            to[s] = x[pick] + np.where(other[pick], y[pick], 0.0)
    return best, feature, at, to_left, left


def grown_at_random(bins: np.ndarray, sizes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, rule: Rule, tree: int) -> Grown:
    """The tree that a :class:`RandomGrower` grows on ``rows``, whose whole-number gradients and hessians are ``g`` and ``h``."""
    spec, (gs, hs) = rule.spec, rule.scales
    least, fewest = LEAST_SHARE * (hs / gs) ** 2, max(spec.min_rows, 1)
    sums = [np.ones(len(rows)), g[rows], h[rows]]
    level = [np.array([v.sum()]) for v in sums]
    keys, slot, live = np.array([root_key(spec.seed, tree)], np.int64), np.zeros(len(rows), np.int64), np.zeros(1, np.int64)
    features, marks, sides, lefts, totals, made, depth = [], [], [], [], [], 1, 0
    while True:
        n_level = len(level[0])
        feature, mark, side, first = np.full(n_level, -1, np.int64), np.zeros(n_level, np.int64), np.zeros(n_level, bool), np.zeros(n_level, np.int64)
        for all_, own in zip((features, marks, sides, lefts, totals), (feature, mark, side, first, level)):
            all_.append(own)
        if not len(live):
            break
        small = np.full(n_level, -1)
        small[live] = np.arange(len(live))
        own = small[slot]
        stay = own >= 0
        rows, own, sums = rows[stay], own[stay], [v[stay] for v in sums]
        gain, f, at, to_left, left = _searched(bins, sizes, rows, own, keys[live], sums, [t[live] for t in level], rule, cuts)
        split = np.flatnonzero(gain > least)
        if not len(split):
            break
        node = live[split]
        feature[node], mark[node], side[node], first[node] = f[split], at[split], to_left[split], made + 2 * np.arange(len(split))
        made += 2 * len(split)
        nth = np.full(len(live), -1)
        nth[split] = np.arange(len(split))
        stay = nth[own] >= 0
        rows, own, sums = rows[stay], own[stay], [v[stay] for v in sums]
        b = np.take(bins.ravel(), f[own] * bins.shape[1] + rows)
        slot = 2 * nth[own] + ~np.where(b == sizes[f[own]] - 1, to_left[own], b <= at[own])
        level = [np.stack([v[split], t[node] - v[split]], axis=1).ravel() for v, t in zip(left, level)]
        keys = np.stack(child_keys(keys[node]), axis=1).ravel()
        depth += 1
        live = np.flatnonzero(level[0] >= 2 * fewest) if depth < spec.max_depth else np.zeros(0, np.int64)
    n_rows, grad, hess = (np.concatenate([t[k] for t in totals]) for k in range(3))
    grad, hess, feature = grad / gs, hess / hs, np.concatenate(features)
    below = hess + spec.l2
    value = np.where((feature < 0) & (below > 0), -spec.rate * grad / np.where(below > 0, below, 1.0), 0.0)
    return Grown(feature, np.concatenate(marks), np.concatenate(sides), np.concatenate(lefts), value[:, None], hess)


def _kept_trees(blocks, grid: Grid, start: float, rule: Rule, place: int, n_trees: int) -> TreeFiles:
    """The trees of one model in files; ``place``: its weights in the blocks."""
    sizes, cuts = grid.sizes, grid.cuts

    def grow(own, trees):
        block = {c: np.ascontiguousarray(np.concatenate([b[c] for b in own], axis=-1)) for c in ("bins", "y", "w", "m", "key")}
        ask = Ask(place, (), np.zeros(0), 0, [], None, rule.spec.loss, rule.scales)
        rows = np.flatnonzero(taken(block, ask))
        g, h = np.zeros(len(block["y"])), np.zeros(len(block["y"]))
        g[rows], h[rows] = slopes(block, sizes, ask, rows)
        for tree in trees:
            yield grown_at_random(bins=block["bins"], sizes=sizes, cuts=cuts, g=g, h=h, rows=rows, rule=rule, tree=tree).row(tree)

    return TreeFiles(keep_trees(SparkSession.active(), dealt_trees(blocks, n_trees, grow)), n_trees, cuts, start=start)


def fit_random_trees(df: DataFrame, values: Column, target: Column, row_id: str, runs: Sequence[Run], max_bins: int = MAX_BINS, part_cells: int = PART_CELLS,
                     passes_only: bool = False, cut_weight: Column | None = None, files: bool = False) -> list[Boosted | TreeFiles]:
    """Fit the trees of all runs together. Arguments as in :func:`boosting.fit_boosters`; weights are 0 or whole counts of a row.

    With ``files``, the trees of a run that are too many for the driver stay in files, unless the table takes shared passes.

    ``cut_weight`` weighs rows for the bins, unless they weigh as in all runs; so runs fitted one after another have the bins of runs fitted together.
    """
    if any(r.spec.growth != "random" for r in runs):
        raise ValueError("all runs need random growth")
    rows = df.where(target.isNotNull()).select(
        values.cast("array<double>").alias("x"), target.cast("double").alias("y"), F.array(*(F.coalesce(r.weight.cast("double"), F.lit(0.0)) for r in runs)).alias("w"),
        F.xxhash64(row_id).alias("key"), *(() if cut_weight is None else (cut_weight.cast("double").alias("_w"),))).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = None
    try:
        w = [F.col("w")[i] for i in range(len(runs))]
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("f"), *(F.struct(
            F.sum(v).alias("w"), F.max(v).alias("top"), F.min(F.when(v > 0, F.col("y"))).alias("lo"),
            F.max(F.when(v > 0, F.col("y"))).alias("hi")).alias(f"r{i}") for i, v in enumerate(w))).first()
        n, n_features = facts["n"], max(facts["f"] or 0, 0)
        if not n or not n_features or any(not facts[f"r{i}"]["w"] for i in range(len(runs))):
            raise ValueError("every model needs rows of weight, and features")
        grid = Grid(quantile_cuts(rows if cut_weight is not None else rows.withColumn("_w", F.aggregate("w", F.lit(0.0), lambda s, v: s + v)), "x", n_features, "_w", max_bins))
        bits = min(30, 61 - n.bit_length())
        starts, growers, which = [], [], []
        for i, run in enumerate(runs):
            f = facts[f"r{i}"]
            starts.append((f["lo"] + f["hi"]) / 2 if run.spec.start is None else run.spec.start)  # no sum, so no order of rows
            reach = max(abs(f["hi"] - starts[i]), abs(f["lo"] - starts[i])) or 1.0
            scales = (2.0**bits / (f["top"] * reach), 2.0**bits / f["top"])
            growers += [RandomGrower(run.spec, k, n_features, starts[i], scales, grid.cuts) for k in range(run.spec.rounds)]
            which += [i] * run.spec.rounds
        parts = n_parts(n * (n_features + 4 * len(runs)), part_cells, len(growers))
        blocks = packed_blocks(rows, grid, starts, parts)
        exact = n * n_features * 2.0**bits <= 2.0**53  # sums of all cells one after another
        if files and parts == 1 and not passes_only and exact and grows_here(n, n_features, len(growers)):
            blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
            first = np.cumsum([0, *(run.spec.rounds for run in runs)])
            return [_kept_trees(blocks, grid, starts[i], Rule(run.spec, growers[first[i]].scales, None), i, run.spec.rounds) for i, run in enumerate(runs)]
        if parts == 1 and not passes_only:
            trees = side_by_side(blocks, growers, grid, drawn_splits, which)
        else:
            blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
            while active := [i for i, g in enumerate(growers) if g.tree is not None]:
                cells = np.cumsum([len(growers[i].open) * grid.total for i in active])
                now = active[:max(1, int(np.searchsorted(cells, PASS_CELLS, "right")))]
                found = one_pass(blocks, parts, grid, [growers[i].ask(which[i]) for i in now], [growers[i].rule() for i in now], drawn_splits)
                for i, splits in zip(now, found):
                    growers[i].told(splits)
                    growers[i].pending.clear()
            trees = [g.trees for g in growers]
        return [Boosted(run.spec, starts[i], [t[0] for t, k in zip(trees, which) if k == i]) for i, run in enumerate(runs)]
    finally:
        if blocks is not None:
            blocks.unpersist()
        rows.unpersist()
