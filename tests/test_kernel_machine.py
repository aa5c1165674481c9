"""The kernel machine against its optimality conditions, checked by SQL over the multipliers, and a plain solver."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.operators import models
from sparktab.operators.kernel_machine import KernelMachine, fit_machines, kernel
from sparktab.plans.bundle import _load_model, _save_model


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = ((x**2).sum(1) + 0.3 * rng.normal(size=300) > 1.3).astype(int)
    return x, y, spark.createDataFrame([(i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(300)], "row_id long, label int, a double, b double").persist()


def plain(k, y, top, rounds=200_000, tol=1e-5):
    """Pairwise ascent on the whole dual."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(rounds):
        s = -y * g
        up, low = np.where(y > 0, a < top, a > 0), np.where(y > 0, a > 0, a < top)
        i, j = int(np.argmax(np.where(up, s, -np.inf))), int(np.argmin(np.where(low, s, np.inf)))
        if s[i] - s[j] < tol:
            return a, (s[i] + s[j]) / 2
        step = (s[i] - s[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, top[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else top[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += y * (k[i] - k[j]) * step
    raise AssertionError("plain solver did not end")


@pytest.mark.parametrize("options", [{}, {"working": 20}, {"working": 60, "part_rows": 60}])
def test_multipliers_meet_the_conditions_and_the_plain_solver(rings, options):
    x, y, df = rings
    weight = F.when(F.col("label") == 1, 0.7).otherwise(1.4)
    tops = [weight * 2.0, F.when(F.col("row_id") % 2 == 0, weight * 2.0)]
    machines, duals = fit_machines(df.repartition(6), F.array("a", "b"), F.col("label") == 1, F.col("row_id"), tops, 0.8, **options)
    for machine, dual, at in zip(machines, duals, (np.arange(300), np.arange(0, 300, 2))):
        table = dual.toPandas()
        worst, balance, outside = conditions(table)
        assert worst < 1e-3 and balance < 1e-8 and outside == 0
        sign, top = np.where(y[at] > 0, 1.0, -1.0), np.where(y[at] > 0, 1.4, 2.8)
        k = kernel(x[at], x[at], 0.8)
        a, offset = plain(k, sign, top)
        # the gradients that the blocks carry are those of the multipliers
        mine = table.set_index("row").loc[at]
        assert np.allclose(mine["gradient"], sign * (k @ (mine["alpha"] * sign)) - 1, atol=1e-9)
        value = lambda v: 0.5 * (v * sign) @ k @ (v * sign) - v.sum()
        assert value(mine["alpha"].to_numpy()) == pytest.approx(value(a), rel=1e-4)
        assert np.allclose(machine.margins(x), kernel(x, x[at], 0.8) @ (a * sign) + offset, atol=0.02)


def conditions(table):
    con = duckdb.connect()
    con.register("dual_rows", table)
    return con.execute("""
        SELECT max(CASE WHEN top > 0 AND (y > 0 AND alpha < top OR y < 0 AND alpha > 0) THEN -y * gradient END)
             - min(CASE WHEN top > 0 AND (y > 0 AND alpha > 0 OR y < 0 AND alpha < top) THEN -y * gradient END),
          abs(sum(alpha * y)), count(*) FILTER (alpha < 0 OR alpha > top + 1e-12) FROM dual_rows""").fetchone()


def test_family_separates_rings_and_reloads(rings, tmp_path):
    x, y, df = rings
    fitted = models.fit_model(df, ["a", "b"], "label", "svc")
    assert isinstance(fitted.model, KernelMachine)
    score = lambda m: np.array([r[0] for r in m.transform(df).orderBy("row_id").select(F.col("probability")[1]).collect()])
    p = score(fitted)
    assert ((p > 0.5) == y).mean() > 0.88 and p[y == 1].mean() > 0.7 > 0.3 > p[y == 0].mean()
    again = _load_model(json.loads(json.dumps(_save_model(fitted, str(tmp_path / "m")))), str(tmp_path / "m"))
    assert np.allclose(score(again), p)


def test_one_class_is_refused(rings):
    _, _, df = rings
    with pytest.raises(ValueError):
        fit_machines(df.where("label = 1"), F.array("a", "b"), F.col("label") == 1, F.col("row_id"), [F.lit(1.0)], 1.0)


def test_a_table_of_many_blocks_needs_few_rounds(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 2))
    y = ((x**2).sum(1) + 0.3 * rng.normal(size=1500) > 1.3).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(1500)], "row_id long, label int, a double, b double").repartition(3)
    [machine], [dual] = fit_machines(df, F.array("a", "b"), F.col("label") == 1, F.col("row_id"), [F.lit(2.0)], 0.8, working=40, part_rows=400, max_rounds=45)
    worst, balance, outside = conditions(dual.toPandas())
    assert worst < 1e-3 and balance < 1e-8 and outside == 0 and len(machine.weights) < 750
