"""Second-order gradient boosting of many models at once, by histogram passes that all of them share.

Rows are cut into bins at weighted quantiles and packed into blocks that stay cached. Every pass asks for the histograms (gradient, hessian, rows per
model, node, feature and bin) of the nodes that all models wait for, finds the best split of each node, and gives the driver nothing but these
splits. A level of all folds and families is one job, whatever the number of models.

- ``level``: all nodes of a depth are split. ``leaf``: the leaf with the highest gain is split next, until ``num_leaves``; the children of every leaf that
  may still be chosen are asked for together, so a tree takes about as many passes as it is deep. ``symmetric``: one split for a whole level.
- A split gains ``T(GL)^2 / (HL + l2) + T(GR)^2 / (HR + l2) - T(G)^2 / (H + l2)``, where T takes ``l1`` off the absolute value; a leaf is worth
  ``-T(G) / (H + l2)`` times the rate. A split needs more than ``LEAST_GAIN``, at least ``gamma``, and enough hessian and rows on both sides.
- Missing values go to the side where they gain more; to the right where training saw none.
- Gradients and hessians are rounded to whole numbers of a fixed unit (2^-30 of their bound), so that sums don't depend on the order of rows:
  the same trees come out for any partitioning and after any retry. Ties go to the first feature and the lowest cut.
- Row samples are digests of row id, seed and round; column samples of seed and round.

A table of at most ``PART_CELLS`` cells (counted) that many models ask, or of at most ``SHARED_CELLS`` cells, lies in one partition: there each model makes
its passes next to a copy of the blocks and the models run side by side; sums are the same whole numbers, so the trees are too. Any other table is spread
over ``FEW_PARTS`` partitions of at least ``SHARED_CELLS`` cells, and over more once these hold ``PART_CELLS``, so a single model's pass is no single task.

Blocks are an RDD of NumPy arrays: a fit is thousands of short passes over the same arrays, and a plan for each of them takes three times as long as the
pass itself. Up to ``FEW_PARTS`` partitions, with histograms of at most ``FEW_CELLS`` cells, sums meet at the driver; beyond that they are
shuffled by ranges of features and reduced where they arrive. Scores are kept in the blocks as soon as the models have finished a tree each, so a pass
routes rows through few finished trees, and written to the checkpoint folder after ``KEEP`` such rounds, so no lineage grows with the rounds.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import ensure_checkpoint_dir
from .ordered import running_totals

MAX_BINS = 256
LEAST_GAIN = 1e-6
BLOCK_ROWS = 1 << 15
#: Cells (rows x columns) of a partition of blocks.
PART_CELLS = 4_000_000
#: Cells that are worth a partition of their own, and the models that make it worth while to keep more in one.
SHARED_CELLS, MANY_MODELS = 400_000, 8
FEW_PARTS, FEW_CELLS = 12, 600_000
#: Cells of a feature range where sums are reduced.
RANGE_CELLS = 1_000_000
#: Refreshed scores after which blocks are written to the checkpoint folder.
KEEP = 64
#: Cells (nodes x bins) whose sums a model keeps for the children's sake.
KEPT_CELLS = 2_000_000
#: Tasks among which the models of a small table are dealt.
MODEL_TASKS = 64


@dataclass(frozen=True)
class BoostSpec:
    """Settings of one model; ``start`` is the first score, None the best constant."""

    rounds: int = 100
    rate: float = 0.1
    growth: str = "level"
    max_depth: int = 6
    num_leaves: int = 0
    l1: float = 0.0
    l2: float = 1.0
    gamma: float = 0.0
    min_hessian: float = 1.0
    min_rows: int = 1
    row_share: float = 1.0
    column_share: float = 1.0
    loss: str = "logistic"
    start: float | None = 0.0
    seed: int = 42

    def __post_init__(self):
        if self.growth not in ("level", "leaf", "symmetric", "random") or self.loss not in ("logistic", "squared"):
            raise ValueError(f"unknown growth or loss: {self.growth!r}, {self.loss!r}")
        if self.rounds < 0 or self.l1 < 0 or self.l2 < 0 or not 0 < self.row_share <= 1 or not 0 < self.column_share <= 1:
            raise ValueError("rounds and penalties are not negative, shares are in (0, 1]")
        if self.growth == "random" and self.loss != "squared":
            raise ValueError("random growth fits numbers")
        if self.growth == "leaf" and self.num_leaves < 2 or self.growth != "leaf" and self.max_depth < 1:
            raise ValueError("leaf-wise growth needs num_leaves, other growth a depth")


#: Types of the nodes' columns; the lists ``feature`` and ``missing_left`` hold small numbers and True or False, so a node takes about 80 bytes.
NODE_TYPES = {"bin": "i", "cut": "d", "left": "i", "right": "i", "depth": "i", "gain": "d", "grad": "d", "hess": "d", "rows": "q", "value": "d"}


@dataclass
class Tree:
    """Nodes as typed arrays; a leaf has feature -1. ``bin`` and ``cut`` name the same place: bins and values up to it go left."""

    feature: Sequence[int] = ()
    bin: Sequence[int] = ()
    cut: Sequence[float] = ()
    missing_left: Sequence[bool] = ()
    left: Sequence[int] = ()
    right: Sequence[int] = ()
    depth: Sequence[int] = ()
    gain: Sequence[float] = ()
    grad: Sequence[float] = ()
    hess: Sequence[float] = ()
    rows: Sequence[int] = ()
    value: Sequence[float] = ()

    def __post_init__(self):
        for name, kind in NODE_TYPES.items():
            setattr(self, name, array(kind, getattr(self, name)))
        self.feature, self.missing_left = list(self.feature), [bool(v) for v in self.missing_left]

    def add(self, depth: int, grad: float, hess: float, rows: int) -> int:
        for name, v in (("feature", -1), ("bin", -1), ("cut", math.nan), ("missing_left", False), ("left", -1), ("right", -1), ("depth", depth), ("gain", 0.0),
                        ("grad", grad), ("hess", hess), ("rows", rows), ("value", 0.0)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def as_dict(self) -> dict:
        return {"feature": list(self.feature), "missing_left": list(self.missing_left)} | {name: getattr(self, name).tolist() for name in NODE_TYPES}

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (
            np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.missing_left, bool), np.array(self.left, np.int32),
            np.array(self.right, np.int32), np.array(self.value, np.float64))


@dataclass
class Boosted:
    """A fitted model."""

    spec: BoostSpec
    start: float
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of raw values (NaN: missing)."""
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for tree in self.trees:
            feature, cut = np.array(tree.feature), np.array(tree.cut)
            left, right, missing_left = np.array(tree.left), np.array(tree.right), np.array(tree.missing_left)
            at = np.zeros(len(x), np.int64)
            for _ in range(max(tree.depth)):
                inner = feature[at] >= 0
                v = x[row, np.maximum(feature[at], 0)]
                goes_left = np.where(np.isnan(v), missing_left[at], v <= cut[at])
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            out += np.array(tree.value)[at]
        return out

    def predict(self, values: Column) -> Column:
        """Probability of the second class, or the predicted number, from an array of feature values."""
        model = self

        @F.pandas_udf("double")
        def scored(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            m = model.margins(np.vstack(x.to_numpy()).astype(np.float64))
            return pd.Series(1 / (1 + np.exp(-m)) if model.spec.loss == "logistic" else m)

        return scored(values)

    def importance(self, n_features: int) -> list[float]:
        """Share of all gains by feature."""
        total = np.zeros(n_features)
        for tree in self.trees:
            inner = np.array(tree.feature) >= 0
            np.add.at(total, np.array(tree.feature)[inner], np.array(tree.gain)[inner])
        return (total / (total.sum() or 1.0)).tolist()

    def node_rows(self, names: Sequence[str]) -> list[tuple]:
        """(round, node, depth, feature, cut, left, right, gain, grad, hess, rows, value) of every node."""
        return [
            (r, i, t.depth[i], names[t.feature[i]] if t.feature[i] >= 0 else None, t.cut[i] if t.feature[i] >= 0 else None, t.left[i], t.right[i], t.gain[i], t.grad[i],
             t.hess[i], t.rows[i], t.value[i])
            for r, t in enumerate(self.trees) for i in range(len(t.feature))
        ]

    def as_dict(self) -> dict:
        return {"spec": asdict(self.spec), "start": self.start, "trees": [t.as_dict() for t in self.trees]}

    @staticmethod
    def from_dict(d: dict) -> "Boosted":
        return Boosted(BoostSpec(**d["spec"]), d["start"], [Tree(**t) for t in d["trees"]])


NODE_SCHEMA = (
    "round int, node int, depth int, feature string, cut double, `left` int, `right` int, gain double, grad double, hess double, n_rows long, value double")


@dataclass
class Run:
    """One model to fit: settings and the weight of each row, zero or null for rows that take no part."""

    spec: BoostSpec
    weight: Column = field(default_factory=lambda: F.lit(1.0))


# ---- bins


def quantile_cuts(df: DataFrame, values: str, n_features: int, weight: str, max_bins: int = MAX_BINS, firsts: bool = False):
    """Upper edges of the bins of each feature, from an array column: every value where there are at most ``max_bins``, else weighted quantiles.

    Values are summed up before they are ordered; running totals cross no task's bounds, so no feature is sorted in one place. With ``firsts`` the
    smallest values of the bins are given beside them.
    """
    long = df.select(F.posexplode(values).alias("j", "v"), F.col(weight).alias("w")).where("v is not null and not isnan(v) and w > 0")
    counted = long.groupBy("j", (F.col("v") + F.lit(0.0)).alias("v")).agg(F.sum("w").alias("w")).persist()
    try:
        sizes = {r["j"]: (r["n"], r["w"]) for r in counted.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect()}
        few = [j for j, (n, _) in sizes.items() if n <= max_bins]
        many = [j for j, (n, _) in sizes.items() if n > max_bins]
        cuts: dict[int, list[tuple[float, float]]] = {j: [] for j in range(n_features)}
        if few:
            for r in counted.where(F.col("j").isin(few)).select("j", "v").collect():  # max_bins of each feature at most
                cuts[r["j"]].append((r["v"], r["v"]))
        if many:
            totals = F.lit(None).cast("double")
            for j in many:
                totals = F.when(F.col("j") == j, F.lit(float(sizes[j][1]))).otherwise(totals)
            ranked = running_totals(counted.where(F.col("j").isin(many)), "v", {"upto": "w"}, by=["j"])
            bins = ranked.withColumn("b", F.least(F.floor((F.col("upto") - F.col("w")) / totals * max_bins), F.lit(max_bins - 1)))
            for r in bins.groupBy("j", "b").agg(F.max("v").alias("v"), F.min("v").alias("first")).collect():
                cuts[r["j"]].append((r["v"], r["first"]))
    finally:
        counted.unpersist()
    edges, starts = ([np.array(sorted(v[k] for v in cuts[j]), np.float64) for j in range(n_features)] for k in (0, 1))
    return (edges, starts) if firsts else edges


@dataclass
class Grid:
    """Bins of all features side by side; the last bin of a feature holds its missing values."""

    cuts: list[np.ndarray]

    def __post_init__(self):
        self.sizes = np.array([len(c) + 1 for c in self.cuts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.total = int(self.offsets[-1])
        self.kind = np.uint8 if self.sizes.max(initial=1) <= 256 else np.uint16

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Features x rows."""
        out = np.empty((len(self.cuts), len(x)), self.kind)
        for j, cuts in enumerate(self.cuts):
            v = x[:, j]
            out[j] = np.where(np.isnan(v), len(cuts), np.minimum(np.searchsorted(cuts, v, "left"), max(len(cuts) - 1, 0)))
        return out

    def ranges(self, width: int) -> list[tuple[int, int]]:
        """Neighbouring features whose bins together are about ``width``."""
        found, low = [], 0
        for j in range(1, len(self.cuts) + 1):
            if j == len(self.cuts) or self.offsets[j + 1] - self.offsets[low] > width:
                found.append((low, j))
                low = j
        return found


# ---- passes over blocks


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with all bits spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def routed(bins: np.ndarray, sizes: np.ndarray, tree: tuple[np.ndarray, ...], at: np.ndarray | None = None) -> np.ndarray:
    """The leaf of each row, from the root or from the nodes ``at``, which are changed; rows in leaves are looked at once."""
    feature, cut, missing_left, left, right, _ = tree
    if at is None:
        at = np.zeros(bins.shape[1], np.int32)
    inner, flat, rows = feature >= 0, bins.ravel(), bins.shape[1]
    live = np.flatnonzero(inner[at])
    last = sizes[feature] - 1
    while len(live):
        node = at[live]
        b = np.take(flat, np.take(feature, node).astype(np.int64) * rows + live)
        goes_left = b <= np.take(cut, node)
        gap = b == np.take(last, node)
        if gap.any():
            goes_left = np.where(gap, missing_left[node], goes_left)
        node = np.where(goes_left, np.take(left, node), np.take(right, node))
        at[live] = node
        live = live[np.take(inner, node)]
    return at


@dataclass
class Ask:
    """What one model wants from a pass: the tree so far, the slot of each node (-1: none), its finished trees not yet in the blocks."""

    run: int
    tree: tuple[np.ndarray, ...]
    slots: np.ndarray
    n_slots: int
    pending: list[tuple[np.ndarray, ...]]
    sample: tuple[float, int] | None
    loss: str
    scales: tuple[float, float]


def scored(block: dict, sizes: np.ndarray, run: int, pending, nodes: np.ndarray | None = None) -> np.ndarray:
    """Scores with the pending trees; ``nodes``: where the rows are in the only one."""
    m = block["m"][run]
    for tree in pending:
        m = m + tree[5][routed(block["bins"], sizes, tree, nodes)]
    return m


def taken(block: dict, ask: Ask) -> np.ndarray:
    """Which rows take part in a tree: those of weight, in its sample."""
    take = block["w"][ask.run] > 0
    if ask.sample is not None:
        share, salt = ask.sample
        take &= (mixed(block["key"] ^ np.uint64(salt)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share
    return take


def slopes(block: dict, sizes: np.ndarray, ask: Ask, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number gradients and hessians of the rows ``at``."""
    m, t, v = scored(block, sizes, ask.run, ask.pending)[at], block["y"][at], block["w"][ask.run][at]
    if ask.loss == "logistic":
        p = 1 / (1 + np.exp(-m))
        g, h = v * (p - t), v * p * (1 - p)
    else:
        g, h = v * (m - t), v
    return np.rint(g * ask.scales[0]), np.rint(h * ask.scales[1])


def slot_sums(bins: np.ndarray, offsets: np.ndarray, slots: np.ndarray, n_slots: int, at: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(slots, bins of all features, 3) sums of the rows ``at``, whose slots, gradients and hessians are given; each of the three lies in one piece."""
    total = int(offsets[-1])
    sums = np.zeros((3, n_slots * total), np.int64)
    base = slots.astype(np.int64) * total
    step = max(1, 2_000_000 // max(len(at), 1))
    for low in range(0, len(bins) if len(at) else 0, step):
        part = np.take(bins[low:low + step], at, axis=1) + offsets[low:low + step][:len(bins) - low, None] + base
        k, flat = len(part), part.ravel()
        for c, values in enumerate((g, h, None)):
            got = np.bincount(flat, None if values is None else np.tile(values, k), minlength=n_slots * total)
            sums[c] += got.astype(np.int64)  # sums of one block are below 2^53, so exact
    return np.moveaxis(sums.reshape(3, n_slots, total), 0, 2)


def block_sums(block: dict, grid_sizes: np.ndarray, offsets: np.ndarray, asks: list[Ask]) -> list[np.ndarray]:
    """(slots, bins of all features, 3) whole-number sums of each ask."""
    out = []
    for ask in asks:
        slot = ask.slots[routed(block["bins"], grid_sizes, ask.tree)]
        at = np.flatnonzero((slot >= 0) & taken(block, ask))
        g, h = slopes(block, grid_sizes, ask, at) if len(at) else (np.zeros(0), np.zeros(0))
        out.append(slot_sums(block["bins"], offsets, slot[at], ask.n_slots, at, g, h))
    return out


class TreeSums:
    """The sums that one model's trees ask for, over blocks that lie next to it.

    Rows keep their node between passes, gradients are computed once for a tree, and of two new nodes only that with fewer rows is summed: the other is what
    its parent has besides. Sums are whole numbers, so the difference is what a pass over the rows gives.
    """

    def __init__(self, blocks: list[dict], place: int, grid: Grid):
        self.blocks, self.place, self.grid = blocks, place, grid
        self.begin()

    def begin(self) -> None:
        """A new tree: all rows are in the root."""
        self.nodes = [np.zeros(b["bins"].shape[1], np.int32) for b in self.blocks]
        self.rows, self.kept = None, {}

    def ask(self, ask: Ask, tree: Tree) -> np.ndarray:
        if self.rows is None:
            self.rows = []
            for b in self.blocks:
                at = np.flatnonzero(taken(b, ask))
                g, h = np.zeros(len(b["y"])), np.zeros(len(b["y"]))
                if len(at):
                    g[at], h[at] = slopes(b, self.grid.sizes, ask, at)
                self.rows.append((at, g, h))
        wanted = np.flatnonzero(ask.slots >= 0)
        wanted = wanted[np.argsort(ask.slots[wanted])].tolist()
        parent = {child: node for node in self.kept for child in (tree.left[node], tree.right[node])}
        sibling = {child: tree.left[node] + tree.right[node] - child for child, node in parent.items()}
        asked = set(wanted)
        larger = {n for n in wanted if n in parent and sibling[n] in asked and (tree.rows[n], n) > (tree.rows[sibling[n]], sibling[n])}
        direct = [n for n in wanted if n not in larger]
        slots = np.full(len(ask.slots), -1, np.int64)
        slots[direct] = np.arange(len(direct))
        sums = 0
        for b, nodes, (at, g, h) in zip(self.blocks, self.nodes, self.rows):
            slot = slots[routed(b["bins"], self.grid.sizes, ask.tree, nodes)[at]]
            at, slot = at[slot >= 0], slot[slot >= 0]
            sums = sums + slot_sums(b["bins"], self.grid.offsets, slot, len(direct), at, g[at], h[at])
        if larger:
            found = dict(zip(direct, sums))
            found |= {n: self.kept[parent[n]] - found[sibling[n]] for n in larger}
            sums = np.moveaxis(np.stack([np.moveaxis(found[n], 1, 0) for n in wanted], axis=1), 0, 2)
        done = {parent[n] for n in wanted if n in parent}
        self.kept = {n: v for n, v in self.kept.items() if n not in done}
        room = KEPT_CELLS // max(self.grid.total, 1) - len(self.kept)
        self.kept |= dict(zip(wanted[:max(room, 0)], sums))
        return sums


@dataclass
class Rule:
    """How the splits of a model are judged."""

    spec: BoostSpec
    scales: tuple[float, float]
    columns: np.ndarray | None  # features that this tree may use; None: all


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def worth(g, h, spec: BoostSpec):
    below = h + spec.l2
    top = (shrunk(g, spec.l1) if spec.l1 else g) ** 2
    return np.divide(top, below, out=np.zeros(np.shape(below)), where=below > 0)


def best_splits(sums: np.ndarray, low: int, high: int, sizes: np.ndarray, rule: Rule) -> list[tuple]:
    """Best split of each slot within the features low .. high - 1: gain, feature, bin, missing left, then G, H and rows of left side and node.

    ``sums`` holds the bins of these features. For symmetric growth the gains of all slots are added, and each slot reports the common split.
    """
    spec, (gs, hs) = rule.spec, rule.scales
    own = sizes[low:high]
    stops = np.cumsum(own)
    starts = stops - own
    total = sums[:, :stops[0]].sum(axis=1)
    spread = np.repeat(np.arange(high - low), own)
    usable = np.ones(len(spread), bool)
    usable[stops - 1] = False
    if rule.columns is not None:
        usable &= np.isin(spread + low, rule.columns)
    parent = worth(total[:, 0] / gs, total[:, 1] / hs, spec)
    left = []
    for c in range(3):  # a piece of memory for each of the three
        upto = np.cumsum(sums[..., c], axis=1)
        left.append(upto - np.where(starts[None] > 0, upto[:, np.maximum(starts - 1, 0)], 0)[:, spread])
    missing = sums[:, stops - 1]
    sides = [left]
    if missing.any():
        sides.append([part + missing[..., c][:, spread] for c, part in enumerate(left)])
    found = []
    for side in sides:
        g, h, n = side[0] / gs, side[1] / hs, side[2]
        rg, rh, rn = (total[:, None, 0] - side[0]) / gs, (total[:, None, 1] - side[1]) / hs, total[:, None, 2] - n
        gain = worth(g, h, spec) + worth(rg, rh, spec) - parent[:, None]
        if spec.growth == "symmetric":
            gain = np.where(usable, np.where((n > 0) & (rn > 0), gain, 0.0).sum(axis=0)[None], -np.inf)
        else:
            fits = (n >= max(spec.min_rows, 1)) & (rn >= max(spec.min_rows, 1)) & (h >= spec.min_hessian) & (rh >= spec.min_hessian) & usable
            gain = np.where(fits, gain, -np.inf)
        found.append((gain, np.argmax(gain, axis=1).tolist()))
    out = []
    for s in range(len(sums)):
        rows = [at[min(s, len(f) - 1)] for f, at in found]
        values = [float(f[min(s, len(f) - 1)][k]) for (f, _), k in zip(found, rows)]
        m = int(len(values) > 1 and values[1] > values[0])  # without missing values both sides are the same
        k = rows[m]
        side = (int(sides[m][c][s, k]) for c in range(3))
        out.append((values[m], low + int(spread[k]), int(k - starts[spread[k]]), bool(m), tuple(side), tuple(int(v) for v in total[s])))
    return out


def merged(parts: Iterable[list[tuple]]) -> list[tuple]:
    """The best of several feature ranges; the first feature among equals."""
    best: list[tuple] | None = None
    for part in sorted(parts, key=lambda p: p[0][1]):
        best = part if best is None else [b if b[0] >= p[0] else p for b, p in zip(best, part)]
    return best or []


# ---- growing trees


class Grower:
    """One model: which nodes it waits for, and what it makes of their splits."""

    def __init__(self, spec: BoostSpec, n_features: int, start: float, scales: tuple[float, float], cuts: list[np.ndarray]):
        self.spec, self.start, self.scales, self.cuts, self.n_features = spec, start, scales, cuts, n_features
        self.trees: list[Tree] = []
        self.pending: list[tuple[np.ndarray, ...]] = []
        self.tree: Tree | None = None
        self.open: list[int] = []
        if spec.rounds:
            self.begin()

    def begin(self) -> None:
        self.tree = Tree()
        self.tree.add(0, 0.0, 0.0, 0)
        self.open, self.known = [0], {}
        self.columns = None
        if self.spec.column_share < 1:
            n = max(1, int(self.spec.column_share * self.n_features))
            order = mixed(np.arange(self.n_features, dtype=np.uint64) ^ np.uint64(self.salt(1)))
            self.columns = np.sort(np.argsort(order, kind="stable")[:n])

    def salt(self, what: int) -> int:
        return int(mixed(np.array([(self.spec.seed * 1_000_003 + len(self.trees)) * 2 + what], np.uint64))[0])

    def ask(self, run: int) -> Ask:
        slots = np.full(len(self.tree.feature), -1, np.int64)
        slots[self.open] = np.arange(len(self.open))
        sample = (self.spec.row_share, self.salt(0)) if self.spec.row_share < 1 else None
        return Ask(run, self.tree.arrays(), slots, len(self.open), list(self.pending), sample, self.spec.loss, self.scales)

    def rule(self) -> Rule:
        return Rule(self.spec, self.scales, self.columns)

    def good(self, gain: float) -> bool:
        return gain > LEAST_GAIN and gain >= self.spec.gamma

    def split(self, node: int, found: tuple) -> tuple[int, int]:
        """Turn a node into an inner one; the new nodes."""
        gain, feature, at, missing_left, side, total = found
        t, (gs, hs) = self.tree, self.scales
        cuts = self.cuts[feature]
        t.feature[node], t.bin[node], t.missing_left[node], t.gain[node] = feature, at, bool(missing_left), gain
        t.cut[node] = float(cuts[at]) if len(cuts) else math.inf
        t.left[node] = t.add(t.depth[node] + 1, side[0] / gs, side[1] / hs, side[2])
        t.right[node] = t.add(t.depth[node] + 1, (total[0] - side[0]) / gs, (total[1] - side[1]) / hs, total[2] - side[2])
        return t.left[node], t.right[node]

    def told(self, splits: list[tuple]) -> bool:
        """Take the splits of the open nodes; whether a tree was finished."""
        if self.open == [0]:
            total = splits[0][5]
            self.tree.grad[0], self.tree.hess[0], self.tree.rows[0] = total[0] / self.scales[0], total[1] / self.scales[1], total[2]
        self.known.update(zip(self.open, splits))
        nodes, self.open = self.open, []
        if self.spec.growth == "leaf":
            self.best_first()
        else:
            deeper = self.tree.depth[nodes[0]] + 1 < self.spec.max_depth
            for node, found in zip(nodes, splits):
                if self.good(found[0]):
                    pair = self.split(node, found)
                    if deeper:
                        self.open += pair if self.spec.growth == "symmetric" else [p for p in pair if self.tree.rows[p] >= 2 * max(self.spec.min_rows, 1)]
        if not self.open:
            self.finish()
        return not self.open or self.open == [0]

    def best_first(self) -> None:
        """Follow the gains from the root. Where children aren't known yet, all leaves that may still be chosen are split ahead and asked for."""
        t, spec = self.tree, self.spec
        leaves, chosen = {0}, []
        while len(leaves) < spec.num_leaves:
            ready = [n for n in leaves if self.good(self.known[n][0]) and (spec.max_depth < 1 or t.depth[n] < spec.max_depth)]
            if not ready:
                break
            ready.sort(key=lambda n: (-self.known[n][0], n))
            node = ready[0]
            if t.feature[node] < 0:
                for ahead in ready[:spec.num_leaves - len(leaves)]:
                    if t.feature[ahead] < 0:
                        self.open += self.split(ahead, self.known[ahead])
                return
            leaves.remove(node)
            leaves |= {t.left[node], t.right[node]}
            chosen.append(node)
            if not {t.left[node], t.right[node]} <= self.known.keys():
                raise AssertionError("children are asked for when a leaf is split ahead")
        self.tree = self.kept(set(chosen))

    def kept(self, chosen: set[int]) -> Tree:
        """The tree of the chosen inner nodes alone, numbered by depth and place."""
        old, new = self.tree, Tree()
        new.add(0, old.grad[0], old.hess[0], old.rows[0])
        line = [(0, 0)]
        for was, now in line:
            if was in chosen:
                for name in ("feature", "bin", "cut", "missing_left", "gain"):
                    getattr(new, name)[now] = getattr(old, name)[was]
                for name in ("left", "right"):
                    child = getattr(old, name)[was]
                    getattr(new, name)[now] = new.add(old.depth[child], old.grad[child], old.hess[child], old.rows[child])
                    line.append((child, getattr(new, name)[now]))
        return new

    def finish(self) -> None:
        """Leaf values; then the next tree."""
        t, spec = self.tree, self.spec
        for i, feature in enumerate(t.feature):
            below = t.hess[i] + spec.l2
            if feature < 0 and below > 0:
                t.value[i] = float(-spec.rate * shrunk(np.float64(t.grad[i]), spec.l1) / below)
        self.trees.append(t)
        self.pending.append(t.arrays())
        self.tree, self.open = None, []
        if len(self.trees) < spec.rounds:
            self.begin()


# ---- fitting


def n_parts(cells: int, part_cells: int, models: int) -> int:
    """Partitions of blocks: one where models are run side by side, else as many as shared passes are spread over."""
    if cells <= part_cells and models >= MANY_MODELS:
        return 1
    return max(1, -(-cells // part_cells), min(FEW_PARTS, -(-cells // SHARED_CELLS)))


def packed_blocks(df: DataFrame, grid: Grid, starts: list[float], parts: int):
    """RDD of blocks from rows of x (array), y, w (array), key."""
    n_features, n_runs = len(grid.cuts), len(starts)

    def pack(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(low, BLOCK_ROWS)
                n = piece.num_rows
                matrix = lambda c, width: piece[c].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, width)
                w = np.ascontiguousarray(np.nan_to_num(matrix("w", n_runs)).T)
                parts_ = [grid.binned(matrix("x", n_features)), piece["y"].to_numpy(zero_copy_only=False).astype(np.float64), w, piece["key"].to_numpy().view(np.uint64)]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts_] + [pa.array([n], pa.int64())], ["bins", "y", "w", "key", "n"])

    def block(row) -> dict:
        n = row["n"]
        return {
            "bins": np.frombuffer(row["bins"], grid.kind).reshape(n_features, n), "y": np.frombuffer(row["y"]), "w": np.frombuffer(row["w"]).reshape(n_runs, n),
            "key": np.frombuffer(row["key"], np.uint64), "m": np.repeat(np.array(starts)[:, None], n, axis=1),
        }

    dealt = df.coalesce(parts) if df.rdd.getNumPartitions() >= parts else df.repartition(parts)
    return dealt.mapInArrow(pack, "bins binary, y binary, w binary, key binary, n long").rdd.map(block)


def one_pass(blocks, parts: int, grid: Grid, asks: list[Ask], rules: list[Rule], judge: Callable = best_splits) -> list[list[tuple]]:
    """Splits of the slots of every ask, as ``judge`` finds them in the sums."""
    sizes, offsets = grid.sizes, grid.offsets
    cells = sum(a.n_slots for a in asks) * grid.total
    if parts <= FEW_PARTS and cells <= FEW_CELLS:
        def summed(part):
            total = None
            for block in part:
                own = block_sums(block, sizes, offsets, asks)
                total = own if total is None else [a + b for a, b in zip(total, own)]
            return [] if total is None else [total]

        found = blocks.mapPartitions(summed).collect()
        return [judge(sum(f[i] for f in found), 0, len(sizes), sizes, rule) for i, rule in enumerate(rules)]
    ranges = grid.ranges(max(1, RANGE_CELLS // sum(a.n_slots for a in asks)))

    def by_range(part):
        total = None
        for block in part:
            own = block_sums(block, sizes, offsets, asks)
            total = own if total is None else [a + b for a, b in zip(total, own)]
        for r, (low, high) in enumerate(ranges if total is not None else []):
            yield r, [t[:, offsets[low]:offsets[high]] for t in total]

    def judged(pair):
        r, sums = pair
        return [judge(s, *ranges[r], sizes, rule) for s, rule in zip(sums, rules)]

    told = blocks.mapPartitions(by_range).reduceByKey(lambda a, b: [x + y for x, y in zip(a, b)], len(ranges), lambda r: r).map(judged).collect()
    return [merged([t[i] for t in told]) for i in range(len(asks))]


def side_by_side(blocks, growers: list[Grower], grid: Grid, judge: Callable = best_splits, which: Sequence[int] | None = None) -> list[list[Tree]]:
    """The trees of models on a table of one partition: each task has the blocks and some of the models; ``which`` names the weights of each."""
    tasks = min(MODEL_TASKS, len(growers))
    sizes = grid.sizes

    def dealt(block):
        for k in range(tasks):
            own = [i if which is None else which[i] for i in range(k, len(growers), tasks)]
            yield k, {**block, "w": block["w"][own], "m": block["m"][own]}

    def grown(pair):
        k, own = pair
        own, found = list(own), []
        for place, i in enumerate(range(k, len(growers), tasks)):
            grower, near = growers[i], TreeSums(own, place, grid)
            while grower.tree is not None:
                sums = near.ask(grower.ask(place), grower.tree)
                grower.told(judge(sums, 0, len(sizes), sizes, grower.rule()))
                if grower.pending:
                    for b, nodes in zip(own, near.nodes):  # trees grown best first are numbered anew
                        b["m"][place] = scored(b, sizes, place, grower.pending, None if grower.spec.growth == "leaf" else nodes)
                    grower.pending.clear()
                    near.begin()
            found.append((i, grower.trees))
        return found

    # The blocks of one partition fit a task's memory by PART_CELLS.
    trees = dict(blocks.flatMap(dealt).groupByKey(tasks, lambda k: k).flatMap(grown).collect())
    return [trees[i] for i in range(len(growers))]


def best_start(loss: str, weighted_mean: float) -> float:
    if loss == "squared":
        return weighted_mean
    p = min(max(weighted_mean, 1e-15), 1 - 1e-15)
    return math.log(p / (1 - p))


def fit_boosters(df: DataFrame, values: Column, target: Column, row_id: str, runs: Sequence[Run], max_bins: int = MAX_BINS, part_cells: int = PART_CELLS, passes_only: bool = False) -> list[Boosted]:
    """Fit all runs together. ``values`` is an array of feature values, ``target`` 0 / 1 or a number; rows without a target take no part.

    ``passes_only`` keeps a small table on shared passes too.
    """
    spark = df.sparkSession
    rows = df.where(target.isNotNull()).select(
        values.cast("array<double>").alias("x"), target.cast("double").alias("y"), F.array(*(F.coalesce(r.weight.cast("double"), F.lit(0.0)) for r in runs)).alias("w"),
        F.xxhash64(row_id).alias("key")).persist(StorageLevel.MEMORY_AND_DISK)
    held = []
    try:
        per_run = [F.struct(F.sum(F.col("w")[i]).alias("w"), F.max(F.col("w")[i]).alias("top"), F.sum(F.col("w")[i] * F.col("y")).alias("wy"),
                            F.min(F.when(F.col("w")[i] > 0, F.col("y"))).alias("lo"), F.max(F.when(F.col("w")[i] > 0, F.col("y"))).alias("hi")).alias(f"r{i}") for i in range(len(runs))]
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("f"), *per_run).first()
        n, n_features = facts["n"], max(facts["f"] or 0, 0)
        if not n or not n_features or any(not facts[f"r{i}"]["w"] for i in range(len(runs))):
            raise ValueError("every model needs rows of weight, and features")
        grid = Grid(quantile_cuts(rows.withColumn("_w", F.aggregate("w", F.lit(0.0), lambda s, v: s + v)), "x", n_features, "_w", max_bins))
        bits = min(30, 61 - n.bit_length())
        growers = []
        for i, run in enumerate(runs):
            f = facts[f"r{i}"]
            start = best_start(run.spec.loss, f["wy"] / f["w"]) if run.spec.start is None else run.spec.start
            reach = 1.0 if run.spec.loss == "logistic" else max(abs(f["hi"] - start), abs(f["lo"] - start), f["hi"] - f["lo"]) or 1.0
            growers.append(Grower(run.spec, n_features, start, (2.0**bits / (f["top"] * reach), 2.0**bits / f["top"]), grid.cuts))
        parts = n_parts(n * (n_features + 4 * len(runs)), part_cells, len(growers))
        blocks = packed_blocks(rows, grid, [g.start for g in growers], parts)
        if parts == 1 and not passes_only:
            return [Boosted(g.spec, g.start, trees) for g, trees in zip(growers, side_by_side(blocks, growers, grid))]
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(blocks)
        refreshed = 0
        while any(g.tree is not None for g in growers):
            active = [i for i, g in enumerate(growers) if g.tree is not None]
            asks = [growers[i].ask(i) for i in active]
            for i, splits in zip(active, one_pass(blocks, parts, grid, asks, [growers[i].rule() for i in active])):
                growers[i].told(splits)
            while len(held) > 1:
                held.pop(0).unpersist()  # the newer blocks have been computed by the pass
            if sum(len(g.pending) for g in growers) >= len(active):
                pending, sizes = [list(g.pending) for g in growers], grid.sizes
                blocks = blocks.map(lambda b, pending=pending: {**b, "m": np.array([scored(b, sizes, i, p) for i, p in enumerate(pending)])}).persist(StorageLevel.MEMORY_AND_DISK)
                refreshed += 1
                if refreshed % KEEP == 0:
                    ensure_checkpoint_dir(spark)
                    blocks.checkpoint()
                held.append(blocks)
                for g in growers:
                    g.pending.clear()
        return [Boosted(g.spec, g.start, g.trees) for g in growers]
    finally:
        for b in held:
            b.unpersist()
        rows.unpersist()
