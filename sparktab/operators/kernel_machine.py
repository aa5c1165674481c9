"""Support vector machine with an RBF kernel, solved by working sets.

The dual of the weighted machine is ``min 1/2 a'Qa - sum(a)`` with ``0 <= a_i <= C w_i`` and ``sum(a_i y_i) = 0``, Q_ij = y_i y_j K(x_i, x_j). Rows lie in
blocks that carry their multipliers and gradients. A round takes the rows that violate optimality most (at most ``WORKING`` of each model, merged
on the way to the driver), solves the small problem between them, and sends the changed multipliers with their rows back; each block then
updates its gradients with one kernel tile, rows x changed rows. So no kernel matrix exists anywhere, and all models that are fitted together (the
folds of the probability fit) share the passes. A model ends when the largest violation is below ``tol``.

Beyond one partition, every block first solves the problem of its own rows, and the rounds start from these multipliers: they stay inside their boxes
and in balance, most support vectors are among them, and one pass gives their gradients. Rounds then only settle what blocks disagree on.

Every row weighs on every other, so the work of a fit grows with rows x support vectors; a fit of more than ``MAX_VECTORS`` support vectors raises
and names the random-feature machine, whose work grows with the rows alone. Ties go to the smaller row number, so a fit doesn't depend on
partitioning but for rounding. Rows with a null feature are refused by the assembler before; weights of zero leave a row out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

#: Rows of a working set: of a table of one partition or inside a block, and of larger tables, whose rounds start from solved blocks.
WORKING, WIDE_WORKING = 400, 800
MAX_VECTORS = 100_000
TOLERANCE = 1e-3
BLOCK_ROWS = 4096
#: Rows of a table that is fitted in one partition, rows of a partition of larger ones, and rounds after which blocks are written to the checkpoint folder.
PART_ROWS, SPREAD_ROWS, KEEP = 20_000, 8_192, 40


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - z|^2) of all rows of a and b."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)
    return np.exp(-gamma * np.maximum(square, 0.0))


@dataclass
class KernelMachine:
    """Support vectors, their signed multipliers and the offset; ``slope`` and ``shift`` turn a margin into a probability."""

    gamma: float
    vectors: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        step = max(1, 4_000_000 // max(len(self.vectors), 1))
        parts = [kernel(x[k:k + step], self.vectors, self.gamma) @ self.weights for k in range(0, len(x), step)]
        return (np.concatenate(parts) if parts else np.zeros(0)) + self.offset

    def margin(self, values: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def scored(x: pd.Series) -> pd.Series:
            return pd.Series(model.margins(np.vstack(x.to_numpy()).astype(np.float64)) if len(x) else [], dtype=float)

        return scored(values)

    def probability(self, values: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * self.margin(values) + F.lit(self.shift))))

    def as_dict(self) -> dict:
        return {"gamma": self.gamma, "vectors": self.vectors.tolist(), "weights": self.weights.tolist(), "offset": self.offset, "slope": self.slope, "shift": self.shift}

    @staticmethod
    def from_dict(d: dict) -> "KernelMachine":
        return KernelMachine(d["gamma"], np.array(d["vectors"]).reshape(len(d["weights"]), -1), np.array(d["weights"]), d["offset"], d["slope"], d["shift"])


def small_problem(k: np.ndarray, y: np.ndarray, top: np.ndarray, alpha: np.ndarray, grad: np.ndarray, tol: float, most: int = 20_000) -> np.ndarray:
    """New multipliers of a working set: pairs of the largest violation, one after another."""
    a, g = alpha.copy(), grad.copy()
    for _ in range(most):
        score = -y * g
        up = np.where(y > 0, a < top, a > 0)
        low = np.where(y > 0, a > 0, a < top)
        i = int(np.argmax(np.where(up, score, -np.inf)))
        gaps = score[i] - score
        bend = np.maximum(k[i, i] + np.diag(k) - 2 * k[i], 1e-12)
        j = int(np.argmax(np.where(low & (gaps > 0), gaps * gaps / bend, -np.inf)))
        worst = score[i] - np.min(np.where(low, score, np.inf))
        if not up.any() or not low.any() or worst < tol:
            break
        step = gaps[j] / bend[j]
        # a_i moves by y_i * step and a_j by -y_j * step, inside their boxes
        step = min(step, top[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else top[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        for r in (i, j):
            a[r] = 0.0 if a[r] < 1e-12 * top[r] else top[r] if a[r] > top[r] * (1 - 1e-12) else a[r]
        g += y * (k[i] - k[j]) * step
    return a


def candidates(block: dict, run: int, n: int) -> list[tuple]:
    """The rows of a block that violate most, upwards and downwards: (score, row, y, top, alpha, gradient, features, up)."""
    y, top, a, g = block["y"], block["top"][run], block["a"][run], block["g"][run]
    score = -y * g
    out = []
    for up in (True, False):
        free = (top > 0) & np.where((y > 0) == up, a < top, a > 0)
        at = np.flatnonzero(free)
        key = -score[at] if up else score[at]
        at = at[np.lexsort((block["row"][at], key))[:n]]
        out += [(float(score[i]), int(block["row"][i]), float(y[i]), float(top[i]), float(a[i]), float(g[i]), block["x"][i], up) for i in at]
    return out


def merged(one: list[list[tuple]], two: list[list[tuple]], n: int) -> list[list[tuple]]:
    """The worst n rows of each direction and model."""
    out = []
    for a, b in zip(one, two):
        both = [*a, *b]
        ups = sorted((r for r in both if r[-1]), key=lambda r: (-r[0], r[1]))[:n]
        out.append(ups + sorted((r for r in both if not r[-1]), key=lambda r: (r[0], r[1]))[:n])
    return out


def moved(block: dict, changes: list[tuple | None], gamma: float) -> dict:
    """The block after the multipliers of some rows have changed."""
    a, g = block["a"].copy(), block["g"].copy()
    for run, change in enumerate(changes):
        if change is None:
            continue
        rows, x, delta, value = change
        g[run] += block["y"] * (kernel(block["x"], x, gamma) @ delta)
        place = np.searchsorted(block["row"], rows)
        mine = (place < len(block["row"])) & (block["row"][np.minimum(place, len(block["row"]) - 1)] == rows)
        a[run, place[mine]] = value[mine]
    return {**block, "a": a, "g": g}


def answered(rows: list[tuple], gamma: float, tol: float) -> tuple | None:
    """The change (rows, features, signed steps, multipliers) that solves the problem between the candidates of a model."""
    own = list({r[1]: r for r in rows}.values())
    x, y = np.stack([r[6] for r in own]), np.array([r[2] for r in own])
    top, alpha, grad = (np.array([r[k] for r in own]) for k in (3, 4, 5))
    new = small_problem(kernel(x, x, gamma), y, top, alpha, grad, tol / 2)
    at = np.flatnonzero(new != alpha)
    at = at[np.argsort(np.array([own[k][1] for k in at]))]
    return np.array([own[k][1] for k in at], np.int64), x[at], ((new - alpha) * y)[at], new[at]


def gap(rows: list[tuple]) -> tuple[float, float] | None:
    """The worst score upwards and downwards; none without candidates of both directions."""
    ups, lows = [r for r in rows if r[-1]], [r for r in rows if not r[-1]]
    return (ups[0][0], lows[0][0]) if ups and lows else None


def started(block: dict, gamma: float, tol: float, max_rounds: int) -> dict:
    """The block with the multipliers that its own rows alone would have; its gradients are left to be computed."""
    n_runs, n = block["a"].shape
    own = {**block, "row": np.arange(n)}
    for run in range(n_runs):
        for _ in range(max_rounds):
            rows = merged([candidates(own, run, WORKING // 2)], [[]], WORKING // 2)[0]
            ends = gap(rows)
            if ends is None or ends[0] - ends[1] < tol:
                break
            changes: list[tuple | None] = [None] * n_runs
            changes[run] = answered(rows, gamma, tol)
            own = moved(own, changes, gamma)
    return {**block, "a": own["a"]}


def signed(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Features and signed multipliers (one column a model) of the rows of a block that weigh in any model."""
    at = np.flatnonzero((block["a"] > 0).any(0))
    return block["x"][at], (block["a"] * block["y"])[:, at].T


def weighed(block: dict, vectors: list[tuple[np.ndarray, np.ndarray]], gamma: float) -> dict:
    """The block with the gradients of given multipliers; one tile serves all models."""
    g = -np.ones(block["a"].shape)
    for x, a in vectors:
        g += block["y"] * (kernel(block["x"], x, gamma) @ a).T
    return {**block, "g": g}


def _blocks(df: DataFrame, n_runs: int, parts: int):
    """RDD of blocks from rows of x (array), y (-1 / 1), top (array) and row, in row order inside a block."""
    def pack(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(low, BLOCK_ROWS)
                n = piece.num_rows
                order = np.argsort(piece["row"].to_numpy())
                flat = lambda c: piece[c].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)[order]
                columns = [flat("x"), piece["y"].to_numpy(zero_copy_only=False)[order], np.ascontiguousarray(flat("top").T), piece["row"].to_numpy()[order]]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns] + [pa.array([n], pa.int64())], ["x", "y", "top", "row", "n"])

    def block(r) -> dict:
        n = r["n"]
        return {"x": np.frombuffer(r["x"]).reshape(n, -1), "y": np.frombuffer(r["y"]), "top": np.frombuffer(r["top"]).reshape(n_runs, n),
                "row": np.frombuffer(r["row"], np.int64), "a": np.zeros((n_runs, n)), "g": -np.ones((n_runs, n))}

    # rows of larger tables are dealt by their number, so that a block is a fair part of the table whatever its order
    dealt = df.coalesce(1) if parts == 1 else df.repartition(parts, "row").sortWithinPartitions("row")
    return dealt.mapInArrow(pack, "x binary, y binary, top binary, row binary, n long").rdd.map(block)


def fit_machines(df: DataFrame, values: Column, positive: Column, row: Column, tops: list[Column], gamma: float, tol: float = TOLERANCE, working: int | None = None,
                 max_rounds: int = 2000, part_rows: int = PART_ROWS) -> tuple[list[KernelMachine], list[DataFrame]]:
    """One machine for each upper bound of the multipliers (zero or null: the row takes no part), and their multipliers (row, y, alpha, gradient).

    ``row`` is a distinct whole number of each row.
    """
    spark = df.sparkSession
    rows = df.select(values.cast("array<double>").alias("x"), F.when(positive, 1.0).otherwise(-1.0).alias("y"), F.array(*(F.coalesce(t.cast("double"), F.lit(0.0)) for t in tops)).alias("top"),
                     row.cast("long").alias("row")).persist(StorageLevel.MEMORY_AND_DISK)
    n = rows.count()
    parts = 1 if n <= part_rows else -(-n // min(part_rows, SPREAD_ROWS))
    n_runs, half = len(tops), (working or (WORKING if parts == 1 else WIDE_WORKING)) // 2
    blocks = _blocks(rows, n_runs, parts).persist(StorageLevel.MEMORY_AND_DISK)
    before, held = None, None
    offsets: list[float | None] = [None] * n_runs
    try:
        if parts > 1:
            before, blocks = blocks, blocks.map(lambda b: started(b, gamma, 10 * tol, max_rounds)).persist(StorageLevel.MEMORY_AND_DISK)
            held = spark.sparkContext.broadcast(blocks.map(signed).collect())
            before.unpersist()
            before, blocks = blocks, blocks.map(lambda b, held=held: weighed(b, held.value, gamma)).persist(StorageLevel.MEMORY_AND_DISK)
        for turn in range(max_rounds):
            waiting = [i for i in range(n_runs) if offsets[i] is None]
            if not waiting:
                break
            empty: list[list[tuple]] = [[] for _ in waiting]
            found = blocks.map(lambda b, waiting=waiting: [candidates(b, i, half) for i in waiting]).treeReduce(lambda p, q: merged(p, q, half))
            if before is not None:
                before.unpersist()
            changes: list[tuple | None] = [None] * n_runs
            for i, rows_ in zip(waiting, merged(found, empty, half)):
                ends = gap(rows_)
                if ends is None:
                    raise ValueError("a machine needs rows of both classes")
                if ends[0] - ends[1] < tol:
                    offsets[i] = (ends[0] + ends[1]) / 2
                    continue
                changes[i] = answered(rows_, gamma, tol)
            if any(c is not None for c in changes):
                # the pass of the next round makes and keeps the new blocks
                before, blocks = blocks, blocks.map(lambda b, changes=changes: moved(b, changes, gamma)).persist(StorageLevel.MEMORY_AND_DISK)
                if turn % KEEP == KEEP - 1:
                    ensure_checkpoint_dir(spark)
                    blocks.checkpoint()
        else:
            raise RuntimeError(f"no machine within {max_rounds} rounds")
        vectors = blocks.map(lambda b: [int((b["a"][i] > 0).sum()) for i in range(n_runs)]).reduce(lambda p, q: [s + t for s, t in zip(p, q)])
        if max(vectors) > MAX_VECTORS:
            raise ValueError(f"{max(vectors)} support vectors are too many to score with; give n_components for a machine on random features")
        kept = blocks.flatMap(lambda b: [(i, b["row"][b["a"][i] > 0], b["x"][b["a"][i] > 0], (b["a"][i] * b["y"])[b["a"][i] > 0]) for i in range(n_runs)]).collect()
        machines, duals = [], []
        for i in range(n_runs):
            own = [k for k in kept if k[0] == i]
            order = np.argsort(np.concatenate([k[1] for k in own]))
            machines.append(KernelMachine(gamma, np.concatenate([k[2] for k in own])[order], np.concatenate([k[3] for k in own])[order], float(offsets[i])))
        final = blocks.flatMap(lambda b: [(int(r), float(b["y"][k]), *(float(v) for i in range(n_runs) for v in (b["top"][i][k], b["a"][i][k], b["g"][i][k]))) for k, r in enumerate(b["row"])])
        names = ", ".join(f"top{i} double, alpha{i} double, gradient{i} double" for i in range(n_runs))
        table = cut_lineage(spark.createDataFrame(final, f"row long, y double, {names}"))
        duals = [table.select("row", "y", F.col(f"top{i}").alias("top"), F.col(f"alpha{i}").alias("alpha"), F.col(f"gradient{i}").alias("gradient")) for i in range(n_runs)]
        return machines, duals
    finally:
        blocks.unpersist()
        rows.unpersist()
        if held is not None:
            held.unpersist()

