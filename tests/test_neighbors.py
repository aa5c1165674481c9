"""Neighbour joins against brute force, on copies, gaps and crowded cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.operators import balance, impute, neighbors


def brute(rows, k, dims):
    out = {}
    for qid, q in rows.items():
        scored = []
        for did, d in rows.items():
            shared = [i for i in range(dims) if q[i] is not None and d[i] is not None]
            if did == qid or not shared:
                continue
            scored.append((sum((q[i] - d[i]) ** 2 for i in shared) * dims / len(shared), did))
        out[qid] = [d for _, d in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["neighbor_id"])
    return out


@pytest.mark.parametrize("direct", [0, 10**6])
@pytest.mark.parametrize("gaps", [0.0, 0.3])
def test_exact_with_copies_and_gaps(spark, direct, gaps):
    rng = random.Random(3)
    rows = {}
    for i in range(400):
        # A third of the rows are copies of one point.
        point = (1.0, 2.0, 3.0) if i % 3 == 0 else tuple(round(rng.gauss(i % 5 * 10, 1), 3) for _ in range(3))
        rows[i] = tuple(None if rng.random() < gaps else v for v in point)
    df = spark.createDataFrame([(i, *v) for i, v in rows.items()], "row_id long, a double, b double, c double")
    got = found(neighbors.knn_join(df, df, ["a", "b", "c"], 4, block_rows=16, direct_rows=direct))
    want = {q: ids for q, ids in brute(rows, 4, 3).items() if ids}
    assert got == want


def test_hot_vector_is_expanded_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "HOT_COPIES", 10)
    df = spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") < 60, 0.0).otherwise(F.col("id").cast("double")).alias("a"))
    got = found(neighbors.knn_join(df, df, ["a"], 2, block_rows=8, direct_rows=0))
    assert got == brute({i: (0.0 if i < 60 else float(i),) for i in range(100)}, 2, 1)


def test_cosine_ignores_zero_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.1])], "id long, v array<double>")
    got = neighbors.cosine_top_k(df, df, "id", "id", "v", 2, 2, exclude_self=True).collect()
    assert {(r["query_id"], r["neighbor_id"]) for r in got} == {(1, 3), (3, 1)}


def test_knn_fill_falls_back_to_the_mean(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0), (3, None, 8.0), (4, 3.0, None)], "row_id long, a double, b double")
    got = {r["row_id"]: (r["a"], r["b"]) for r in impute.fit_knn(df, ["a", "b"], "row_id", 2).transform(df).collect()}
    # No pair of rows shares a known column, so every fill is a column mean.
    assert got == {1: (1.0, 6.0), 2: (2.0, 4.0), 3: (2.0, 8.0), 4: (3.0, 6.0)}


@pytest.fixture
def classes(spark):
    rng = random.Random(5)
    rows = [(i, int(i % 6 == 0), rng.gauss(3 * (i % 6 == 0), 1), rng.gauss(0, 1)) for i in range(120)]
    return spark.createDataFrame(rows, "row_id long, label int, x double, y double")


def test_smote_points_lie_between_class_mates(classes):
    out = balance.smote(classes, ["x", "y"], "label", "row_id", 3)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
    points = {r["row_id"]: (r["x"], r["y"], r["label"]) for r in classes.collect()}
    for r in out.where("is_synthetic = 1").collect():
        a, b = points[r["row_id"]], points[r["neighbor_id"]]
        assert a[2] == b[2] == r["label"] == 1
        span = [(r["x"] - a[0], b[0] - a[0]), (r["y"] - a[1], b[1] - a[1])]
        u = span[0][0] / span[0][1]
        assert -1e-9 <= u <= 1 + 1e-9 and span[1][0] == pytest.approx(u * span[1][1], abs=1e-9)


def test_smote_does_not_depend_on_partitions(classes):
    one = balance.smote(classes.coalesce(1), ["x", "y"], "label", "row_id").select("row_id", "copy", "x", "y").collect()
    many = balance.smote(classes.repartition(9), ["x", "y"], "label", "row_id", block_rows=8).select("row_id", "copy", "x", "y").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_small_class_is_refused(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 0, 1.0), (3, 0, 2.0), (4, 0, 3.0)], "row_id long, label int, x double")
    with pytest.raises(ValueError):
        balance.smote(df, ["x"], "label", "row_id", 3)


def test_cleaning_removes_what_it_should(classes):
    cols = ["x", "y"]
    for fn in (balance.smote_tomek, balance.smote_enn):
        out = fn(classes, cols, "label", "row_id")
        assert 0 < out.count() <= 200 and out.select("new_id").distinct().count() == out.count()
    kept = balance.smote_enn(classes, cols, "label", "row_id").where("is_synthetic = 0")
    assert kept.count() <= 120


@pytest.mark.parametrize("dim,gaps", [(2, 0.0), (2, 0.3), (12, 0.0)])
def test_blocks_met_one_after_another_leave_the_nearest(dim, gaps):
    rng = np.random.default_rng(dim)
    d = np.round(rng.normal(size=(300, dim)), 1 if dim == 2 else 6)
    d[::7] = d[0]  # ties go to the smaller id
    d[rng.random(d.shape) < gaps] = np.nan
    q, keys = d[:90] + 0.0, rng.permutation(300)
    best = neighbors._Best(q, 4)
    for start in range(0, 300, 64):
        best.meet(d[start:start + 64], keys[start:start + 64])
    for i in range(len(q)):
        dist = neighbors.squared_distances(q[i], d)
        order = np.lexsort((keys, dist))[:4]
        order = order[np.isfinite(dist[order])]
        assert best.id[i][:len(order)].tolist() == keys[order].tolist() and best.d2[i][:len(order)].tolist() == dist[order].tolist()
        assert np.isinf(best.d2[i][len(order):]).all()


def test_far_blocks_are_skipped_and_groups_are_bounded(spark, monkeypatch):
    """tasks got pairs of blocks as Python rows, up to 10,000 of them at a time; every pair of rows of two blocks was compared."""
    best, measured = neighbors._Best(np.array([[0.0], [0.1]]), 2), []
    best.meet(np.array([[0.0], [0.2], [0.3]]), np.array([1, 2, 3]))
    monkeypatch.setattr(neighbors, "squared_distances", lambda q, d: measured.append(len(q)) or np.zeros(len(q)))
    best.meet(np.array([[5.0], [6.0]]), np.array([4, 5]))
    assert not measured and best.id.tolist() == [[1, 2], [1, 2]]
    side = (["a", "b", "c"], np.array([10, 600, 5000]), np.array([[0.0], [1.0], [50.0]]), np.array([[1.0], [2.0], [60.0]]))
    members, meets, parts = neighbors._groups(side, side, 700, 1, False)
    assert parts == {"a": 1, "b": 1, "c": 5} and len({m[2] for m in members}) == 6  # a and b share a group
    assert sorted((g, c) for g, c, _ in meets if g == 0) == [(0, "a"), (0, "b"), (0, "c")] and [m[1] for m in meets if m[0] > 0] == ["c"] * 5
    df = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") * 1.5).alias("a"))
    plan = neighbors.knn_join(df, df, ["a"], 2, block_rows=8, direct_rows=0)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
