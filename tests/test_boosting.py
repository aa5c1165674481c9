"""Shared boosting passes against plain Python, and the properties of each way of growing."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.operators import boosting, models
from sparktab.operators.boosting import BoostSpec, Boosted, Run, fit_boosters
from sparktab.operators.encode import ordered_target_statistics


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = np.stack([rng.integers(0, 6, n) / 2, rng.integers(0, 9, n) * 1.0, rng.normal(size=n)], axis=1)
    x[rng.random((n, 3)) < 0.08] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=2) * np.nan_to_num(x[:, 2], nan=1) + 0.2 * rng.normal(size=n) > 0.4).astype(float)
    rows = [(i, float(y[i]), [None if math.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "row_id long, y double, x array<double>").persist()


def fit(df, *specs, **options):
    return fit_boosters(df, F.col("x"), F.col("y"), "row_id", [Run(s) for s in specs], **options)


def plain_levels(x, y, w, spec):
    """Level-wise boosting by trying every cut of every node."""
    margin, out = np.full(len(y), spec.start), []
    shrunk = lambda g: math.copysign(max(abs(g) - spec.l1, 0.0), g)
    worth = lambda g, h: shrunk(g) ** 2 / (h + spec.l2) if h + spec.l2 > 0 else 0.0
    for _ in range(spec.rounds):
        p = 1 / (1 + np.exp(-margin)) if spec.loss == "logistic" else None
        g, h = (w * (p - y), w * p * (1 - p)) if p is not None else (w * (margin - y), w.copy())
        step = np.zeros(len(y))

        def grow(rows, depth):
            gt, ht = g[rows].sum(), h[rows].sum()
            best = None
            if depth < spec.max_depth:
                for missing_left in (False, True):
                    for j in range(x.shape[1]):
                        for cut in np.unique(x[:, j][~np.isnan(x[:, j])]):
                            left = np.where(np.isnan(x[rows, j]), missing_left, x[rows, j] <= cut)
                            a, b = rows[left], rows[~left]
                            if min(len(a), len(b)) < spec.min_rows or min(h[a].sum(), h[b].sum()) < spec.min_hessian:
                                continue
                            gain = worth(g[a].sum(), h[a].sum()) + worth(g[b].sum(), h[b].sum()) - worth(gt, ht)
                            if gain > 1e-6 and gain >= spec.gamma and (best is None or gain > best[0] + 1e-9):
                                best = (gain, a, b)
            if best is None:
                step[rows] = -spec.rate * shrunk(gt) / (ht + spec.l2) if ht + spec.l2 > 0 else 0.0
            else:
                grow(best[1], depth + 1)
                grow(best[2], depth + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + step
        out.append(margin)
    return out


@pytest.mark.parametrize("options", [
    {}, {"l1": 2.0, "l2": 3.0}, {"gamma": 4.0}, {"min_hessian": 12.0}, {"min_rows": 60, "min_hessian": 0.0}, {"loss": "squared", "min_hessian": 0.0, "start": 0.3},
])
def test_levels_follow_the_formula(data, options):
    x, y, df = data
    spec = BoostSpec(rounds=3, rate=0.3, max_depth=3, **options)
    want = plain_levels(x, y, np.ones(len(y)), spec)[-1]
    got = fit(df, spec, max_bins=1000)[0].margins(x)
    assert np.allclose(got, want, atol=1e-6)


def test_penalties_and_gamma_change_the_trees(data):
    x, _, df = data
    base, l1, l2, gamma, heavy = fit(df, *(BoostSpec(rounds=2, max_depth=4, **o) for o in ({}, {"l1": 3.0}, {"l2": 30.0}, {"gamma": 6.0}, {"min_hessian": 25.0})))
    size = lambda m: sum(len(t.feature) for t in m.trees)
    assert size(gamma) < size(base) and size(heavy) < size(base)
    assert max(np.abs(m.margins(x)).max() for m in (l1, l2)) < np.abs(base.margins(x)).max()
    assert all(g >= 6.0 for t in gamma.trees for f, g in zip(t.feature, t.gain) if f >= 0)


SHAPES = [
    BoostSpec(rounds=12, max_depth=4, row_share=0.7, column_share=0.7), BoostSpec(rounds=12, growth="leaf", num_leaves=9, max_depth=0, l2=0.0, min_hessian=1e-3, min_rows=5, start=None),
    BoostSpec(rounds=12, growth="symmetric", max_depth=4, l2=3.0, min_hessian=0.0), BoostSpec(rounds=12, max_depth=3, loss="squared", start=None, min_hessian=0.0),
]


def test_every_way_of_running_gives_the_same_trees(data):
    _, _, df = data
    text = lambda models_: json.dumps([m.as_dict() for m in models_])
    want = text(fit(df, *SHAPES))
    assert text(fit(df.repartition(5), *SHAPES)) == want
    assert text(fit(df, *SHAPES, passes_only=True)) == want
    assert text(fit(df.repartition(7, "row_id"), *SHAPES, part_cells=1500)) == want  # several partitions
    held = boosting.FEW_CELLS, boosting.RANGE_CELLS
    boosting.FEW_CELLS, boosting.RANGE_CELLS = 0, 400  # sums by ranges of features
    try:
        assert text(fit(df, *SHAPES, part_cells=1500)) == want
    finally:
        boosting.FEW_CELLS, boosting.RANGE_CELLS = held


def test_leaves_bound_the_leafwise_tree_and_gains_its_order(data):
    _, _, df = data
    model = fit(df, BoostSpec(rounds=4, growth="leaf", num_leaves=9, max_depth=0, l2=0.0, min_hessian=1e-3, min_rows=5))[0]
    for t in model.trees:
        leaves = [i for i, f in enumerate(t.feature) if f < 0]
        assert len(leaves) == 9 and all(t.rows[i] >= 5 for i in leaves)
    assert len({t.depth[i] for i, f in enumerate(model.trees[0].feature) if f < 0}) > 1
    # A smaller tree holds the splits of the highest gains of the larger one, from the root on.
    small = fit(df, BoostSpec(rounds=1, growth="leaf", num_leaves=4, max_depth=0, l2=0.0, min_hessian=1e-3, min_rows=5))[0].trees[0]
    inner = lambda t: sorted(((g, f) for g, f in zip(t.gain, t.feature) if f >= 0), reverse=True)
    assert set(inner(small)) <= set(inner(model.trees[0]))
    flat = fit(df, BoostSpec(rounds=1, growth="leaf", num_leaves=9, max_depth=2, l2=0.0, min_hessian=1e-3, min_rows=5))[0].trees[0]
    assert max(flat.depth) <= 2


def test_symmetric_levels_share_one_split(data):
    _, _, df = data
    for t in fit(df, BoostSpec(rounds=3, growth="symmetric", max_depth=4, l2=3.0, min_hessian=0.0))[0].trees:
        assert sum(f < 0 for f in t.feature) == 2 ** max(t.depth)
        for d in range(max(t.depth)):
            assert len({(t.feature[i], t.bin[i], t.missing_left[i]) for i in range(len(t.feature)) if t.depth[i] == d}) == 1


def test_weights_mask_rows(data):
    x, y, df = data
    spec = BoostSpec(rounds=3, max_depth=3)
    half = fit_boosters(df, F.col("x"), F.col("y"), "row_id", [Run(spec, F.when(F.col("row_id") % 2 == 0, 1.0))], max_bins=1000)[0]
    at = np.arange(len(y)) % 2 == 0
    assert np.allclose(half.margins(x[at]), plain_levels(x[at], y[at], np.ones(at.sum()), spec)[-1], atol=1e-6)
    with pytest.raises(ValueError):
        fit_boosters(df, F.col("x"), F.col("y"), "row_id", [Run(spec, F.lit(0.0))])
    with pytest.raises(ValueError):
        fit(df.limit(0), spec)


def test_quantile_bins_are_weighted(spark):
    df = spark.range(10_000).select(F.array(F.col("id").cast("double"), F.lit(None).cast("double"), (F.col("id") % 3).cast("double")).alias("x"), F.when(F.col("id") < 100, 99.0).otherwise(1.0).alias("w"))
    cuts = boosting.quantile_cuts(df, "x", 3, "w", 16)
    assert len(cuts[0]) == 16 and sum(c < 100 for c in cuts[0]) == 8 and cuts[0][-1] == 9999.0 and len(cuts[1]) == 0 and cuts[2].tolist() == [0.0, 1.0, 2.0]


def test_scores_of_missing_and_unseen_values(data, spark):
    x, _, df = data
    model = Boosted.from_dict(json.loads(json.dumps(fit(df, SHAPES[1])[0].as_dict())))
    odd = spark.createDataFrame([([None, None, None],), ([100.0, -5.0, 1e9],)], "x array<double>").select(F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"))
    got = [r["p"] for r in odd.select(model.predict(F.col("x")).alias("p")).collect()]
    m = model.margins(np.array([[np.nan] * 3, [100.0, -5.0, 1e9]]))
    assert np.allclose(got, 1 / (1 + np.exp(-m))) and sum(model.importance(3)) == pytest.approx(1.0)
    assert len(model.node_rows("abc")) == sum(len(t.feature) for t in model.trees)


def test_bad_settings_are_refused():
    for bad in ({"growth": "other"}, {"loss": "other"}, {"rounds": -1}, {"l2": -1.0}, {"row_share": 0.0}, {"growth": "leaf"}, {"max_depth": 0}):
        with pytest.raises(ValueError):
            BoostSpec(**bad)


def test_no_family_ignores_its_penalties(spark):
    assert models.IGNORED == {"lgbm": ("subsample",)}
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.hash("id") % 7).cast("double").alias("a"), (F.hash("id", F.lit(1)) % 5).cast("double").alias("b"))
    df = df.withColumn("label", (F.col("a") * F.col("b") > 2).cast("int")).persist()
    score = lambda family, **p: [r[0] for r in models.fit_model(df, ["a", "b"], "label", family, p).transform(df).orderBy("row_id").select(F.col("probability")[1]).collect()]
    small = {"xgb": {"n_estimators": 4}, "lgbm": {"n_estimators": 4}, "catboost": {"iterations": 4}}
    for family, changed in (("xgb", {"reg_alpha": 5.0}), ("xgb", {"reg_lambda": 20.0}), ("xgb", {"gamma": 20.0}), ("lgbm", {"reg_alpha": 5.0}), ("lgbm", {"reg_lambda": 20.0}), ("catboost", {"l2_leaf_reg": 50.0})):
        assert score(family, **small[family]) != score(family, **small[family], **changed), (family, changed)


def test_ordered_statistics_see_earlier_rows_only(spark):
    import hashlib

    rows = [(i, None if i % 7 == 0 else "ab"[i % 2], float(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, c string, label double")
    for target in (2_000_000, 5):
        got = {r["row_id"]: r["statistic"] for r in ordered_target_statistics(df, "c", "label", "row_id", 0.4, 2.0, target_rows=target).collect()}
        order = sorted(rows, key=lambda r: hashlib.md5(f"42:{r[0]}".encode()).hexdigest())
        seen = {}
        for i, c, label in order:
            n, s = seen.get(c, (0, 0.0))
            assert got[i] == pytest.approx((s + 0.8) / (n + 2)), (i, target)
            seen[c] = (n + 1, s + label)


def test_one_model_is_spread_and_routes_few_finished_trees(data, monkeypatch):
    """a single model on 240,000 rows had one task, and every pass routed all rows through up to seven finished trees."""
    _, _, df = data
    assert boosting.n_parts(240_000 * 10, boosting.PART_CELLS, 1) == 6 and boosting.n_parts(100_000_000, boosting.PART_CELLS, 1) == 25
    assert boosting.n_parts(240_000 * 10, boosting.PART_CELLS, 36) == 1 and boosting.n_parts(100, boosting.PART_CELLS, 1) == 1
    seen, ask = [], boosting.Grower.ask
    monkeypatch.setattr(boosting.Grower, "ask", lambda self, run: seen.append(len(self.pending)) or ask(self, run))
    fit(df, BoostSpec(rounds=6, growth="level", max_depth=2), passes_only=True)
    assert max(seen) <= 1


def test_rows_are_routed_on_from_kept_places(data):
    """Places kept between the passes of a tree give the leaves that a walk from the root gives."""
    tree = (np.array([0, -1, 1, -1, -1], np.int32), np.array([0, -1, 1, -1, -1], np.int32), np.array([True, False, False, False, False]),
            np.array([1, -1, 3, -1, -1], np.int32), np.array([2, -1, 4, -1, -1], np.int32), np.zeros(5))
    root = tuple(a[:3].copy() for a in tree)
    root[0][2] = -1
    bins, sizes = np.array([[0, 1, 2, 1, 0], [0, 1, 2, 3, 1]], np.uint8), np.array([3, 4])
    places = boosting.routed(bins, sizes, root)
    assert places.tolist() == [1, 2, 1, 2, 1]
    assert boosting.routed(bins, sizes, tree, places).tolist() == boosting.routed(bins, sizes, tree).tolist() == [1, 3, 1, 4, 1]


def test_sums_next_to_the_blocks_are_those_of_a_pass():
    """Of two new nodes one is summed and the other taken off their parent; with missing values, weights, samples and all growths."""
    rng = np.random.default_rng(3)
    n = 700
    x = rng.normal(size=(n, 3)).round(1)
    x[rng.random((n, 3)) < 0.1] = np.nan
    grid = boosting.Grid([np.unique(x[:, j][~np.isnan(x[:, j])]) for j in range(3)])
    half = lambda at: {"bins": grid.binned(x[at]), "y": (np.nan_to_num(x[at, 0]) > 0).astype(float), "w": rng.integers(0, 3, (1, len(at))).astype(float), "m": np.zeros((1, len(at))),
                       "key": rng.integers(0, 2**62, len(at)).astype(np.uint64)}
    for growth, options in (("level", {"row_share": 0.7}), ("leaf", {"num_leaves": 9, "max_depth": 0}), ("symmetric", {"max_depth": 3})):
        blocks = [half(np.arange(300)), half(np.arange(300, n))]
        grower = boosting.Grower(boosting.BoostSpec(**{"rounds": 3, "growth": growth, "min_hessian": 0.0} | options), 3, 0.0, (2.0**20, 2.0**20), grid.cuts)
        near, passes = boosting.TreeSums(blocks, 0, grid), 0
        while grower.tree is not None:
            ask = grower.ask(0)
            whole = sum(boosting.block_sums(b, grid.sizes, grid.offsets, [ask])[0] for b in blocks)
            found = near.ask(ask, grower.tree)
            assert found.shape == whole.shape and (found == whole).all()
            grower.told(boosting.best_splits(found, 0, 3, grid.sizes, grower.rule()))
            passes += 1
            if grower.pending:
                for b in blocks:
                    b["m"][0] = boosting.scored(b, grid.sizes, 0, grower.pending)
                grower.pending.clear()
                near.begin()
        assert passes >= 6
