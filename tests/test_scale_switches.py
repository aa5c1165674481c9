"""Both sides of size switches with gaps, NaN and ties; large counts; large offsets; spellings; skewed classes."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sparktab.functions.text import compact_normalize, normalize_text
from sparktab.operators.balance import oversample, smote
from sparktab.operators.encode import label_codes
from sparktab.operators.metrics import curve_points, ranking_metrics
from sparktab.operators.ordered import global_rank
from sparktab.operators.outlier import OutlierTamer
from sparktab.operators.quantiles import quantiles
from sparktab.operators.schema import count_and_choose
from sparktab.operators.select import anova_f
from sparktab.operators.semantic import match_exact
from sparktab.operators.split import stratified_folds, stratified_holdout


@pytest.fixture(scope="module")
def gaps(spark):
    random.seed(4)
    rows = [(i, None if i % 2 else float(random.choice([1, 2, 2, 3, 50, random.random() * 100])), float("nan") if i % 5 == 0 else float(i % 13)) for i in range(4000)]
    return spark.createDataFrame(rows, "row_id long, x double, y double").persist(), rows


def test_counts_leave_out_nulls_and_nan(gaps):
    frame, rows = gaps
    wide, counts, n = count_and_choose(frame, ["x", "y"], 10)
    assert n == 4000 and counts == {"x": 2000, "y": 3200} and wide == ["x", "y"]
    few = frame.select("row_id", F.when(F.col("y") < 10, F.col("y")).otherwise(F.lit(float("nan"))).alias("y"))
    assert count_and_choose(few, ["y"], 10)[0] == []  # ten values and NaN


@pytest.mark.parametrize("most", [100, 10**6])
def test_wrong_counts_do_not_change_quantiles(gaps, most):
    frame, rows = gaps
    x = sorted(r[1] for r in rows if r[1] is not None)
    got = quantiles(frame, {"x": (F.col("x"), [0.5, 0.9])}, max_values=most, counts={"x": 4000})["x"]
    assert got[0] == pytest.approx(statistics.median(x))
    spot = 0.9 * (len(x) - 1)
    assert got[1] == pytest.approx(x[int(spot)] + (spot % 1) * (x[int(spot) + 1] - x[int(spot)]))


def test_tamer_is_the_same_on_both_sides_of_the_switch(gaps, monkeypatch):
    import sparktab.operators.quantiles as q

    frame, _ = gaps
    whole = OutlierTamer("statistical", "winsorize").fit(frame, ["x", "y"]).state
    monkeypatch.setattr(q.quantiles, "__defaults__", (100, None))
    cut = OutlierTamer("statistical", "winsorize").fit(frame, ["x", "y"]).state
    assert vars(whole) == vars(cut)


def test_area_of_very_large_counts(spark):
    """Weights of 4e9 for each score and class; the long product would overflow."""
    points = spark.createDataFrame([(0.9, 4 * 10**9, 0), (0.5, 4 * 10**9, 4 * 10**9), (0.1, 0, 4 * 10**9)], "score double, tp long, fp long")
    points = points.withColumns({"ctp": F.when(F.col("score") > 0.6, 4 * 10**9).otherwise(8 * 10**9).cast("long"), "cfp": F.when(F.col("score") > 0.6, 0).when(
        F.col("score") > 0.2, 4 * 10**9).otherwise(8 * 10**9).cast("long"), "pos": F.lit(8 * 10**9), "neg": F.lit(8 * 10**9)})
    assert ranking_metrics(points).first()["roc_auc"] == pytest.approx(0.875)


def test_area_with_ties_equals_the_pairwise_share(spark):
    random.seed(2)
    rows = [(random.randint(0, 1), random.choice([0.1, 0.2, 0.2, 0.7])) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    expected = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    for size in (2_000_000, 2):
        frame = spark.createDataFrame(rows, "label int, score double")
        assert ranking_metrics(curve_points(frame, target_rows=size)).first()["roc_auc"] == pytest.approx(expected)


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9, 1.7e12])
def test_anova_does_not_feel_an_offset(spark, offset):
    random.seed(1)
    values = [(i % 3, float(random.randint(0, 999)) + 100 * (i % 3)) for i in range(600)]
    groups = [[v for k, v in values if k == g] for g in range(3)]
    grand = statistics.fmean(v for _, v in values)
    between = sum(len(g) * (statistics.fmean(g) - grand) ** 2 for g in groups) / 2
    within = sum((v - statistics.fmean(g)) ** 2 for g in groups for v in g) / (len(values) - 3)
    frame = spark.createDataFrame([(k, v + offset) for k, v in values], "label int, x double")
    assert anova_f(frame, ["x"], "label").first()["f_value"] == pytest.approx(between / within, rel=1e-4)


def test_spellings_of_one_name_meet(spark):
    frame = spark.createDataFrame([("سن۱۲ كد",), ("سن12 کد",), ("Straße",), ("STRASSE",), ("ＡＢＣ",), ("abc",)], "name string")
    plain = [r[0] for r in frame.select(normalize_text(F.col("name"))).collect()]
    full = [r[0] for r in frame.select(normalize_text(F.col("name"), unicode=True)).collect()]
    assert plain[0] == plain[1] and full[0] == full[1] and full[2] == full[3] and full[4] == full[5]
    aliases = spark.createDataFrame([("c1", "كد ملي", "fa", 0), ("c2", "age", "en", 1)], "concept_id string, text string, language string, position long")
    names = spark.createDataFrame([("کد_ملی",), ("کدملي",), ("Age",)], "name string")
    got = {r.name: (r.concept_id, r.stage) for r in match_exact(names, aliases).collect()}
    assert got == {"کد_ملی": ("c1", "exact"), "کدملي": ("c1", "compact"), "Age": ("c2", "exact")}
    assert frame.select(compact_normalize(F.col("name"))).count() == 6


@pytest.mark.parametrize("few", [0, 20_000])
def test_few_rows_make_many_copies(spark, monkeypatch, few):
    import sparktab.operators.balance as balance

    monkeypatch.setattr(balance, "FEW_ROWS", few)
    frame = spark.range(5007).select(F.col("id").alias("row_id"), (F.col("id") >= 5000).cast("int").alias("label"), (F.col("id") % 50).cast("double").alias("x"))
    made = oversample(frame, "label", "row_id").where("is_synthetic = 1").groupBy("row_id").count().collect()
    assert sum(r["count"] for r in made) == 4993 and len(made) == 7 and max(r["count"] for r in made) - min(r["count"] for r in made) <= 1
    drawn = smote(frame, ["x"], "label", "row_id", k=3).where("is_synthetic = 1")
    assert drawn.count() == 4993 and drawn.where(~F.col("x").between(0, 6)).count() == 0 and drawn.select("row_id", "copy").distinct().count() == 4993


def test_copies_are_the_same_on_both_sides(spark, monkeypatch):
    import sparktab.operators.balance as balance

    frame = spark.range(57).select(F.col("id").alias("row_id"), (F.col("id") >= 50).cast("int").alias("label"), (F.col("id") % 50).cast("double").alias("x"))
    rows = []
    for few in (0, 20_000):
        monkeypatch.setattr(balance, "FEW_ROWS", few)
        rows.append(sorted(map(str, smote(frame, ["x"], "label", "row_id", k=3).collect())))
    assert rows[0] == rows[1]


def test_text_labels_are_numbered_in_order(spark, monkeypatch):
    import sparktab.operators.encode as encode

    words = sorted({f"{a}{b}" for a in ("", "a", "abcdef", "abcdeg", "é", "z") for b in ("", "x", "yy", "é", "10", "9")} - {""}, key=lambda w: w.encode())
    monkeypatch.setattr(encode, "global_rank", lambda *a, **k: global_rank(*a, **k, target_rows=4))
    got = {r.value: r.code for r in label_codes(spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "t string"), "t").collect()}
    assert got == {w: i for i, w in enumerate(words)}


def test_folds_shuffle_the_table_once(spark):
    frame = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("label"))
    out = stratified_folds(frame, "label", "row_id", 5, target_rows=500)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    sizes = [r["count"] for r in out.groupBy("label", "fold").count().collect()]
    assert len(sizes) == 15 and set(sizes) == {200}
    held = stratified_holdout(frame, "label", "row_id", 0.2, target_rows=500)
    assert {r["count"] for r in held.where("is_holdout").groupBy("label").count().collect()} == {200} and math.isclose(held.count(), 3000)
