"""Exact k-nearest-neighbour join without a cross join.

Rows are gathered in cells (nearest pivot, and for incomplete rows the set of
known columns).  The box around each cell gives a lower and an upper bound on
the distance between any two of its rows, so a query cell meets only the donor
cells that can still hold one of its k nearest rows.  Query cells with the same
donor cells form groups of bounded size, donor cells blocks of bounded size; a
task holds one group with its best rows so far and reads the donor blocks one
after another, nearest cells first.  Only queries whose distance to the box of a
block is within their worst kept row meet the block.  Rows with equal
coordinates count as one query and at most k+1 donors, which keeps a large
group of copies from meeting itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numbers import dot, l2_normalize
from .quantiles import clean_numeric

BLOCK_ROWS = 1_024
MAX_CELLS = 2_048
MAX_PATTERNS = 256
HOT_COPIES = 100_000
DIRECT_ROWS = 20_000
DIRECT_CELLS = 2_000_000
#: Donors of a block that is sent to every task, and queries that meet them at a time.
DIRECT_BLOCK, DIRECT_QUERIES = 256, 2_048
#: Rows of a group of queries, and groups that a table is cut into as long as they are smaller.
GROUP_ROWS, GROUPS = 16_384, 64
#: Partitions that groups are dealt over.
SPREAD = 256
#: Pairs whose bounds are held at a time, and coordinates of pairs that are measured at a time.
PAIR_CELLS, MEASURED_CELLS = 1_000_000, 1_000_000
MAX_HOT_VECTORS = 5_000
PIVOT_SAMPLE = 20_000


def _vector(cols: Sequence[str]):
    """Known coordinates as doubles, missing ones as NaN."""
    return F.array(*[F.coalesce(clean_numeric(F.col(c)), F.lit(float("nan"))) for c in cols])


def _choose_pivots(points: DataFrame, n_cells: int, seed) -> np.ndarray:
    """A hash sample of bounded size, thinned to spread-out pivots by farthest-first choice."""
    if n_cells <= 1:
        return np.zeros((1, 0))
    sample = (
        points.select("vec", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("vec").cast("string"))).alias("h"))
        .orderBy("h")
        .limit(min(PIVOT_SAMPLE, n_cells * 8))
        .collect()
    )
    rows = np.nan_to_num(np.array([r["vec"] for r in sample], dtype=float))
    chosen = [0]
    gap = ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < min(n_cells, len(rows)):
        nxt = int(gap.argmax())
        if gap[nxt] <= 0:
            break
        chosen.append(nxt)
        gap = np.minimum(gap, ((rows - rows[nxt]) ** 2).sum(1))
    return rows[chosen]


def _pattern():
    return F.array_join(F.transform("vec", lambda x: F.when(F.isnan(x), "0").otherwise("1")), "")


def _with_cell(points: DataFrame, pivots: np.ndarray, mixed: bool) -> DataFrame:
    """Cell name = known-column pattern + nearest pivot."""
    pattern = F.lit("*") if mixed else _pattern()
    if pivots.shape[1] == 0:
        return points.withColumn("cell", F.concat_ws(":", pattern, F.lit("0")))

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        x = np.nan_to_num(np.vstack(vectors.to_numpy()))
        step = max(1, PAIR_CELLS // len(pivots))
        size = (pivots * pivots).sum(1)[None, :]
        return pd.Series(np.concatenate([(size - 2 * x[i:i + step] @ pivots.T).argmin(1) for i in range(0, len(x), step)]).astype("int32"))

    return points.withColumn("cell", F.concat_ws(":", pattern, nearest("vec").cast("string")))


def _cell_boxes(points: DataFrame, dim: int):
    """One row per cell: box and row count (at most MAX_CELLS times the number of patterns)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(dim):
        x = F.get("vec", F.lit(i))
        x = F.when(~F.isnan(x), x)
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    rows = points.groupBy("cell").agg(*aggs).collect()
    nan = lambda v: np.nan if v is None else v
    lo = np.array([[nan(r[f"lo{i}"]) for i in range(dim)] for r in rows], dtype=float).reshape(len(rows), dim)
    hi = np.array([[nan(r[f"hi{i}"]) for i in range(dim)] for r in rows], dtype=float).reshape(len(rows), dim)
    return [r["cell"] for r in rows], np.array([r["n"] for r in rows], dtype=np.int64), lo, hi


def _donor_cells(q, d, need: int, dim: int, mixed: bool):
    """For each query cell, the places of donor cells that can hold one of the ``need`` nearest rows, by lower bound of the distance.

    Cells of mixed patterns give no bound, so every pair of them is compared.
    """
    q_names, _, q_lo, q_hi = q
    _, d_n, d_lo, d_hi = d
    for i in range(len(q_names)):
        if mixed:
            yield np.arange(len(d_n)), np.zeros(len(d_n))
            continue
        gap = np.maximum(0.0, np.maximum(d_lo - q_hi[i], q_lo[i] - d_hi))
        far = np.maximum(np.abs(d_hi - q_lo[i]), np.abs(q_hi[i] - d_lo))
        shared = ~np.isnan(gap)
        known = shared.sum(1)
        stretch = dim / np.maximum(known, 1)
        lower = np.where(shared, gap**2, 0).sum(1) * stretch
        upper = np.where(shared, far**2, 0).sum(1) * stretch
        usable = known > 0
        order = np.argsort(np.where(usable, upper, np.inf), kind="stable")
        seen = np.cumsum(np.where(usable[order], d_n[order], 0))
        enough = np.searchsorted(seen, need)
        bound = upper[order[enough]] if enough < len(order) and usable[order[enough]] else np.inf
        slack = 1e-9 * (1.0 + bound) if np.isfinite(bound) else 0.0
        met = np.flatnonzero(usable & (lower <= bound + slack))
        yield met, lower[met]


def _groups(q, d, need: int, dim: int, mixed: bool) -> tuple[list[tuple[str, int, int]], list[tuple[int, str, float]], dict[str, int]]:
    """(query cell, part, group), (group, donor cell, nearness), and the parts of each query cell.

    Cells that meet the same donor cells share a group as long as it is small; a large cell is cut into parts.
    """
    names, sizes = q[0], q[1].tolist()
    most = int(min(GROUP_ROWS, max(BLOCK_ROWS, math.ceil(sum(sizes) / GROUPS))))
    members, meets, parts, filling = [], [], {}, {}
    made = 0
    for name, n, (met, lower) in zip(names, sizes, _donor_cells(q, d, need, dim, mixed)):
        parts[name] = max(1, math.ceil(n / most))
        same = met.tobytes()
        for part in range(parts[name]):
            group, rows = filling.get(same, (None, most)) if parts[name] == 1 else (None, most)
            if rows + n > most:
                group, rows, made = made, 0, made + 1
                meets += [(group, d[0][j], float(v)) for j, v in zip(met.tolist(), lower.tolist())]
            if parts[name] == 1:
                filling[same] = (group, rows + n)
            members.append((name, part, group))
    return members, meets, parts


def _blocks(points: DataFrame, parts: dict[str, int]) -> DataFrame:
    """Pack each cell in blocks, one row per block; the table of cells is bounded and broadcast."""
    known = points.sparkSession.createDataFrame(list(parts.items()), "cell string, parts int")
    split = points.join(F.broadcast(known), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    rows = split.groupBy("cell", "part").agg(F.collect_list(F.struct("key", "vec")).alias("rows"))
    return rows.select("cell", "part", F.transform("rows", lambda r: r["key"]).alias("keys"), F.flatten(F.transform("rows", lambda r: r["vec"])).alias("vecs"))


def squared_distances(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Squared distances over shared coordinates, scaled by (all / shared), summed in the order of the coordinates; infinite when none is shared."""
    diff = q - d
    known = ~np.isnan(diff)
    shared = known.sum(axis=-1)
    total = np.cumsum(np.where(known, diff * diff, 0.0), axis=-1)[..., -1] if diff.shape[-1] else np.zeros(diff.shape[:-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared == diff.shape[-1], total, np.where(shared > 0, total * (diff.shape[-1] / shared), np.inf))


def _bounds(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that the squared distances of all pairs lie between, by matrix products: dim multiplications a pair, whatever is missing."""
    kq, kd = ~np.isnan(q), ~np.isnan(d)
    q0, d0 = np.where(kq, q, 0.0), np.where(kd, d, 0.0)
    whole = kq.all() and kd.all()
    size = (q0 * q0).sum(1)[:, None] + (d0 * d0).sum(1)[None, :] if whole else (q0 * q0) @ kd.T.astype(float) + kq.astype(float) @ (d0 * d0).T
    rough, slack = size - 2.0 * (q0 @ d0.T), 1e-12 * size
    if whole:
        return rough - slack, rough + slack
    shared = kq.astype(float) @ kd.T.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        stretch = np.where(shared > 0, q.shape[1] / shared, np.inf)
        return (np.where(shared > 0, (rough + sign * slack) * stretch, np.inf) for sign in (-1, 1))


class _Best:
    """The nearest donors that a set of queries has met so far, by (distance, id); donors without a shared coordinate do not count."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.d2 = np.full((len(q), k), np.inf)
        self.id = np.full((len(q), k), np.iinfo(np.int64).max)
        self.whole = not np.isnan(q).any()
        self.small = q.shape[1] > 8 and self.whole and np.abs(q).max(initial=0.0) < 1e15  # bounds in single precision
        self.size = (q * q).sum(1)

    def lower(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """What the squared distances to all points of a box are not below."""
        gap = np.maximum(0.0, np.maximum(lo - self.q, self.q - hi))
        return (gap * gap).sum(1) * (1 - 1e-12)

    def meet(self, d: np.ndarray, keys: np.ndarray, which: np.ndarray | None = None) -> None:
        """Compare a block of donors with the queries ``which`` (None: all) that may still gain from it."""
        if not len(d) or not len(self.q) or not self.k:
            return
        whole = self.whole and not np.isnan(d).any()
        near = np.arange(len(self.q)) if which is None else which
        if whole:
            near = near[(self.lower(d.min(0), d.max(0)) <= self.d2[:, -1])[near]]
        step = max(1, PAIR_CELLS // len(d))
        kind = np.float32 if whole and self.small and np.abs(d).max(initial=0.0) < 1e15 else np.float64
        slack = (d.shape[1] + 8) * 2.0**-22 if kind is np.float32 else 1e-12
        if whole:  # low bounds are one product: |q|^2 + |d|^2 - 2 q d, less the rounding
            size = (d * d).sum(1)
            right = np.concatenate([d, np.ones((len(d), 1)), (1 - slack) * size[:, None]], axis=1).astype(kind)
        for start in range(0, len(near), step):
            at = near[start:start + step]
            worst = self.d2[at, -1]
            top = min(self.k, len(d))
            with np.errstate(invalid="ignore", over="ignore"):
                if whole:
                    left = np.concatenate([-2.0 * self.q[at], (1 - slack) * self.size[at][:, None], np.ones((len(at), 1))], axis=1).astype(kind)
                    low = left @ right.T
                    low[np.isnan(low)] = -np.inf
                    if not np.isfinite(worst).all():
                        edge = np.partition(low, top - 1, axis=1)[:, top - 1] + 2 * slack * (self.size[at] + size.max()) + 2e-30
                        worst = np.where(np.isfinite(worst) | (top < self.k), worst, np.where(np.isnan(edge), np.inf, edge))
                    limit = np.nextafter((worst + 1e-30).astype(kind), kind(np.inf))
                    q_at, d_at = np.nonzero(low <= limit[:, None])
                else:
                    low, high = _bounds(self.q[at], d)
                    low, high = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)
                    edge = np.partition(high, top - 1, axis=1)[:, top - 1]
                    worst = np.minimum(worst, edge) if top == self.k else worst
                    q_at, d_at = np.nonzero((low <= worst[:, None]) & (low < np.inf))
            piece = max(1, MEASURED_CELLS // d.shape[1])
            for low_at in range(0, len(q_at), piece):
                a, b = q_at[low_at:low_at + piece], d_at[low_at:low_at + piece]
                self.keep(at[a], squared_distances(self.q[at[a]], d[b]), keys[b])

    def keep(self, at: np.ndarray, d2: np.ndarray, ids: np.ndarray) -> None:
        """Put pairs among the kept ones of their queries."""
        fits = d2 <= self.d2[at, -1]
        fits &= np.isfinite(d2)
        at, d2, ids = at[fits], d2[fits], ids[fits]
        if not len(at):
            return
        who = np.unique(at)
        all_at = np.concatenate([at, np.repeat(who, self.k)])
        all_d2, all_id = np.concatenate([d2, self.d2[who].ravel()]), np.concatenate([ids, self.id[who].ravel()])
        order = np.lexsort((all_id, all_d2, all_at))
        all_at, all_d2, all_id = all_at[order], all_d2[order], all_id[order]
        first = np.searchsorted(all_at, who)
        take = (first[:, None] + np.arange(self.k)).ravel()  # each of them has k kept ones, so at least k rows
        self.d2[who], self.id[who] = all_d2[take].reshape(-1, self.k), all_id[take].reshape(-1, self.k)

    def table(self, name: str, keys) -> pa.RecordBatch:
        """(key, found) of every query."""
        held = np.isfinite(self.d2)
        ends = np.concatenate([[0], np.cumsum(held.sum(1))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(self.d2[held], pa.float64()), pa.array(self.id[held], pa.int64())], ["d2", "id"])
        return pa.RecordBatch.from_arrays([keys if isinstance(keys, pa.Array) else pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pairs)], [name, "found"])


def _group_candidates(k: int, dim: int):
    """Rows come sorted: the blocks of a group's queries, then its donor blocks."""
    def run(batches):
        group, keys, vecs, best = None, [], [], None
        for batch in batches:
            for g, is_donor, ids, flat in zip(batch["grp"].to_pylist(), batch["is_donor"].to_pylist(), batch["keys"], batch["vecs"]):
                if g != group:
                    if best is not None:
                        yield best.table("key", np.concatenate(keys))
                    group, keys, vecs, best = g, [], [], None
                ids, vec = ids.values.to_numpy(), flat.values.to_numpy().reshape(-1, dim)
                if not is_donor:
                    keys.append(ids.copy())
                    vecs.append(vec.copy())
                elif keys:
                    best = best or _Best(np.concatenate(vecs), k)
                    best.meet(vec, ids)
        if best is not None:
            yield best.table("key", np.concatenate(keys))

    return run


def _direct_candidates(queries: DataFrame, donors: DataFrame, k: int) -> DataFrame:
    """``(id, key, found)`` against donors of checked size, sent to every task once, in blocks along their widest coordinate."""
    sc = queries.sparkSession.sparkContext
    rows = donors.collect()
    vec, keys = np.array([r["vec"] for r in rows], dtype=float), np.array([r["key"] for r in rows], dtype=np.int64)
    whole = bool(len(rows)) and not np.isnan(vec).any()
    if whole:
        order = np.argsort(vec[:, np.argmax(vec.max(0) - vec.min(0))], kind="stable") if vec.shape[1] else np.arange(len(vec))
        vec, keys = vec[order], keys[order]
    held = sc.broadcast((vec, keys))
    block = DIRECT_BLOCK if whole and vec.shape[1] <= 8 else BLOCK_ROWS

    def run(batches):
        d_vec, d_keys = held.value
        blocks = [(d_vec[i:i + block], d_keys[i:i + block]) for i in range(0, len(d_keys), block)]
        for batch in batches:
            for start in range(0, batch.num_rows, DIRECT_QUERIES):
                part = batch.slice(start, DIRECT_QUERIES)
                best = _Best(part["vec"].flatten().to_numpy().reshape(part.num_rows, -1), k)
                if whole and best.whole and len(blocks) > 1:
                    own = np.argmin([best.lower(v.min(0), v.max(0)) for v, _ in blocks], axis=0)
                    for i, (v, ids) in enumerate(blocks):
                        best.meet(v, ids, np.flatnonzero(own == i))
                    for i, (v, ids) in enumerate(blocks):
                        best.meet(v, ids, np.flatnonzero(own != i))
                else:
                    for v, ids in blocks:
                        best.meet(v, ids)
                yield best.table("id", part["id"])

    spread = queries.select("id", "vec").repartition(sc.defaultParallelism, "id")
    return spread.mapInArrow(run, "id long, found array<struct<d2: double, id: long>>")


def _candidates(queries: DataFrame, donors: DataFrame, dim: int, k: int, block_rows: int, seed) -> DataFrame:
    """``(key, found)`` with the k nearest donors of every query; both sides are (key, vec)."""
    spark = queries.sparkSession
    sized = donors.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(_pattern()).alias("p")).first()
    q_patterns = queries.agg(F.approx_count_distinct(_pattern())).first()[0]
    patterns = max(sized["p"], q_patterns, 1)
    mixed = patterns > MAX_PATTERNS
    most = MAX_CELLS if mixed else max(1, MAX_CELLS // patterns)
    pivots = _choose_pivots(donors, max(1, min(most, math.ceil(sized["n"] / (2 * block_rows)))), seed)
    queries, donors = (_with_cell(p, pivots, mixed).persist(StorageLevel.MEMORY_AND_DISK) for p in (queries, donors))
    q_boxes, d_boxes = _cell_boxes(queries, dim), _cell_boxes(donors, dim)
    members, meets, q_parts = _groups(q_boxes, d_boxes, k, dim, mixed)
    d_parts = {c: math.ceil(n / block_rows) for c, n in zip(d_boxes[0], d_boxes[1].tolist())}
    groups = 1 + max((m[2] for m in members), default=0)
    # A donor block goes once to each group that may need it; the queries themselves are sent once.
    asking = _blocks(queries, q_parts).join(F.broadcast(spark.createDataFrame(members, "cell string, part int, grp int")), ["cell", "part"])
    giving = _blocks(donors, d_parts).join(spark.createDataFrame(meets, "grp int, cell string, near double"), "cell")
    both = asking.select("grp", F.lit(False).alias("is_donor"), F.lit(0.0).alias("near"), "keys", "vecs").unionByName(
        giving.select("grp", F.lit(True).alias("is_donor"), "near", "keys", "vecs"))
    spread = both.repartition(min(4 * groups, SPREAD), "grp").sortWithinPartitions("grp", "is_donor", "near")
    found = spread.select("grp", "is_donor", "keys", "vecs").mapInArrow(_group_candidates(k, dim), "key long, found array<struct<d2: double, id: long>>")
    merged = found.groupBy("key").agg(F.flatten(F.collect_list("found")).alias("all"))
    return merged.select("key", F.slice(F.array_sort("all"), 1, k).alias("found"))


def _expand_copies(points: DataFrame, unique: DataFrame, shared: DataFrame) -> DataFrame:
    """``(id, key)`` of rows whose vector occurs more than once.

    A vector held by very many rows is looked up by broadcast: by the
    threshold there are at most MAX_HOT_VECTORS of them.
    """
    rows = unique.agg(F.sum("copies")).first()[0] or 0
    limit = max(HOT_COPIES, rows // MAX_HOT_VECTORS)
    same = F.col("vec") == F.col("_vec")
    hot = shared.join(unique.where(F.col("copies") > limit).select("key"), "key", "left_semi")
    cold = points.join(F.broadcast(hot), same, "left_anti").join(shared, same).select("id", "key")
    return cold.unionByName(points.join(F.broadcast(hot), same).select("id", "key"))


def knn_join(
    queries: DataFrame,
    donors: DataFrame,
    cols: Sequence[str],
    k: int,
    query_id: str = "row_id",
    donor_id: str = "row_id",
    exclude_self: bool = True,
    block_rows: int = BLOCK_ROWS,
    direct_rows: int = DIRECT_ROWS,
    seed=42,
) -> DataFrame:
    """``(query_id, rank, neighbor_id, distance)``: the k nearest donors of every query, ties by id.

    Distances are Euclidean over ``cols``; a missing coordinate is skipped and
    the rest is scaled up.  ``exclude_self`` drops the donor with the query's
    id.  Donors up to ``direct_rows`` (counted first) are broadcast; beyond
    that the join runs cell by cell.
    """
    cols = list(cols)
    donor_points = donors.select(F.col(donor_id).cast("long").alias("key"), _vector(cols).alias("vec"))
    query_points = queries.select(F.col(query_id).cast("long").alias("id"), _vector(cols).alias("vec"))
    return _join_points(query_points, donor_points, len(cols), k, exclude_self, block_rows, direct_rows, seed)


def _join_points(query_points, donor_points, dim: int, k: int, exclude_self: bool, block_rows: int, direct_rows: int, seed) -> DataFrame:
    """The join on ready vectors: (id, vec) against (key, vec)."""
    want = k + 1 if exclude_self else k
    few = min(direct_rows, DIRECT_CELLS // max(dim, 1))
    if few and donor_points.limit(few + 1).count() <= few:
        answered = _direct_candidates(query_points, donor_points, want)
    else:
        answered = _answer_by_cells(query_points, donor_points, dim, want, block_rows, seed)
    mine = F.filter("found", lambda s: s["id"] != F.col("id")) if exclude_self else F.col("found")
    ranked = answered.select("id", F.posexplode(F.slice(mine, 1, k)).alias("pos", "s"))
    return ranked.select(
        F.col("id").alias("query_id"),
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("s.id").alias("neighbor_id"),
        F.sqrt("s.d2").alias("distance"),
    )


def _answer_by_cells(query_points: DataFrame, donor_points: DataFrame, dim: int, want: int, block_rows: int, seed) -> DataFrame:
    # Among equal rows only the first ``want`` ids can be chosen.
    w = W.partitionBy("vec").orderBy("key")
    kept = donor_points.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= want).drop("_n")
    # One query per distinct vector, named by its smallest id.
    unique = query_points.groupBy("vec").agg(F.min("id").alias("key"), F.count(F.lit(1)).alias("copies"))
    near = _candidates(unique.select("key", "vec"), kept, dim, want, block_rows, seed)
    solo = unique.where("copies = 1").select(F.col("key").alias("id"), "key")
    shared = unique.where("copies > 1").select("key", F.col("vec").alias("_vec"))
    return solo.unionByName(_expand_copies(query_points, unique, shared)).join(near, "key").select("id", "found")


def cosine_top_k(
    queries: DataFrame,
    index: DataFrame,
    query_id: str,
    index_id: str,
    vector: str,
    dim: int,
    k: int = 5,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """``(query_id, rank, neighbor_id, score)``: highest cosine of unit vectors, by the same join.

    On unit vectors cosine = 1 - distance^2 / 2, so the nearest rows are the most similar ones.
    A query whose vector is all zeros has no match.
    """
    def unit(df, key, name):
        nonzero = df.where(dot(F.col(vector), F.col(vector)) > 0)
        return nonzero.select(F.col(key).cast("long").alias(name), l2_normalize(F.col(vector)).alias("vec"))

    near = _join_points(unit(queries, query_id, "id"), unit(index, index_id, "key"), dim, k, exclude_self, block_rows, direct_rows, 42)
    return near.withColumn("score", 1 - F.col("distance") * F.col("distance") / 2).drop("distance")
