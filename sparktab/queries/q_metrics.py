"""Ranking metrics, operating points, search tables and surrogate tables on a score table that covers all events."""

from pyspark.sql import functions as F

from ..functions.numbers import normal_cdf
from ..operators import metrics
from ..operators.split import stratified_folds
from ..plans import search, surrogate
from .bases import ORDERS, SCORES, orders, query, round_all, scores, table, with_

# The checks count pairs and rescan the table per threshold; they share no step with the Spark plans.
POINTS = """
th AS (SELECT DISTINCT score AS t FROM sc), nn AS (SELECT sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM sc),
cv AS (SELECT t, sum((score >= t AND label = 1)::INT)::DOUBLE AS tp, sum((score >= t AND label = 0)::INT)::DOUBLE AS fp FROM th, (SELECT score, label FROM sc) GROUP BY t)
"""
BY = ["candidate", "repeat", "fold"]
G_POINTS = """
th AS (SELECT DISTINCT candidate, repeat, fold, score AS t FROM sc),
nn AS (SELECT candidate, repeat, fold, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM sc GROUP BY ALL),
cv AS (SELECT candidate, repeat, fold, t, sum((score >= t AND label = 1)::INT)::DOUBLE AS tp, sum((score >= t AND label = 0)::INT)::DOUBLE AS fp
  FROM th JOIN sc USING (candidate, repeat, fold) GROUP BY ALL),
pt AS (SELECT cv.*, pos, neg, tp / (tp + fp) AS p, tp / pos AS r FROM cv JOIN nn USING (candidate, repeat, fold))
"""
AUC_SQL = """
au AS (SELECT a.candidate, a.repeat, a.fold, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / (count(*)) AS roc_auc
  FROM sc a JOIN sc b USING (candidate, repeat, fold) WHERE a.label = 1 AND b.label = 0 GROUP BY ALL),
ap AS (SELECT candidate, repeat, fold, sum((r - coalesce(pr, 0)) * p) AS pr_auc FROM
  (SELECT *, lag(r) OVER (PARTITION BY candidate, repeat, fold ORDER BY t DESC) AS pr FROM pt) GROUP BY ALL)
"""


def _points(spark, sf, **kw):
    return metrics.curve_points(scores(spark, sf), **kw)


@query("e1_roc_auc", with_(SCORES) + """
SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6)::DOUBLE AS roc_auc FROM sc a, sc b WHERE a.label = 1 AND b.label = 0""")
def e1(spark, sf):
    return round_all(metrics.ranking_metrics(_points(spark, sf)).select("roc_auc"))


@query("e2_average_precision", with_(SCORES, POINTS) + """
SELECT round(sum((r - coalesce(pr, 0)) * p), 6) AS pr_auc FROM (SELECT tp / pos AS r, tp / (tp + fp) AS p, lag(tp / pos) OVER (ORDER BY t DESC) AS pr FROM cv, nn)""")
def e2(spark, sf):
    return round_all(metrics.ranking_metrics(_points(spark, sf, target_rows=200)).select("pr_auc"))


@query("e1_e2_by_fold", with_(SCORES, G_POINTS, AUC_SQL) + "SELECT candidate, repeat, fold, round(roc_auc, 6)::DOUBLE AS roc_auc, round(pr_auc, 6) AS pr_auc FROM au JOIN ap USING (candidate, repeat, fold)")
def e12(spark, sf):
    return round_all(metrics.ranking_metrics(_points(spark, sf, by=BY), BY))


@query("e3_pr_curve", with_(SCORES, POINTS) + 'SELECT t AS threshold, round(tp / (tp + fp), 6) AS "precision", round(tp / pos, 6) AS recall FROM cv, nn')
def e3(spark, sf):
    return round_all(metrics.pr_curve(_points(spark, sf)))


@query("e4_roc_curve", with_(SCORES, POINTS) + """
SELECT round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr, t AS threshold FROM cv, nn UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, NULL""")
def e4(spark, sf):
    return round_all(metrics.roc_curve(_points(spark, sf)))


def _f_sql(beta2):
    return with_(SCORES, POINTS) + f"""
, f AS (SELECT t, tp / (tp + fp) AS p, tp / pos AS r FROM cv, nn), g AS (SELECT *, {1 + beta2} * p * r / greatest({beta2} * p + r, 1e-12) AS f FROM f)
SELECT t AS threshold, round(f, 6) AS f_score, round(p, 6) AS "precision", round(r, 6) AS recall FROM g ORDER BY round(f, 12) DESC, t LIMIT 1"""


@query("e5_best_f1", _f_sql(1))
def e5(spark, sf):
    return round_all(metrics.best_f_threshold(_points(spark, sf), beta=1.0))


@query("e6_best_f2", _f_sql(4))
def e6(spark, sf):
    return round_all(metrics.best_f_threshold(_points(spark, sf), beta=2.0))


@query("e7_recall_at_specificity", with_(SCORES, POINTS) + """
SELECT round(tp / pos, 6) AS recall_at_spec, t AS threshold FROM cv, nn WHERE 1 - fp / neg >= 0.90 ORDER BY tp DESC, t DESC LIMIT 1""")
def e7(spark, sf):
    return round_all(metrics.recall_at_specificity(_points(spark, sf)))


@query("e8_confusion", with_(SCORES) + """
SELECT y AS label, h AS pred, count(row_id) AS n FROM (SELECT unnest([0, 0, 1, 1]) AS y, unnest([0, 1, 0, 1]) AS h) LEFT JOIN sc ON label = y AND (score >= 0.5)::INT = h GROUP BY ALL""")
def e8(spark, sf):
    return metrics.confusion(scores(spark, sf), 0.5)


@query("e9_report", with_(SCORES) + """
, c AS (SELECT sum((label = 1 AND score >= 0.5)::INT)::DOUBLE AS tp, sum((label = 0 AND score >= 0.5)::INT)::DOUBLE AS fp, sum((label = 1 AND score < 0.5)::INT)::DOUBLE AS fn,
  sum((label = 0 AND score < 0.5)::INT)::DOUBLE AS tn FROM sc),
r AS (SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS s FROM c UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), tp + fn FROM c),
f AS (SELECT *, 2 * p * r / (p + r) AS f FROM r)
SELECT class, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, s::BIGINT AS support FROM f UNION ALL
SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(s)::BIGINT FROM f UNION ALL
SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), sum(s)::BIGINT FROM f UNION ALL
SELECT 'accuracy', a, a, a, n FROM (SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS a, (tp + tn + fp + fn)::BIGINT AS n FROM c)""")
def e9(spark, sf):
    return round_all(metrics.classification_report(metrics.confusion(scores(spark, sf), 0.5)))


@query("e10_brier", with_(SCORES) + "SELECT candidate, round(avg((score - label) * (score - label)), 6) AS brier FROM sc GROUP BY 1")
def e10(spark, sf):
    return round_all(metrics.brier(scores(spark, sf), ["candidate"]))


YHAT = """
yh AS (SELECT (event_id % 5)::INTEGER AS fold, value AS y, value * 0.5 + (event_id % 13) AS yhat FROM events)
"""


def _yhat(spark, sf):
    return table(spark, sf, "events").select((F.col("event_id") % 5).cast("int").alias("fold"), F.col("value").alias("y"),
                                              (F.col("value") * 0.5 + F.col("event_id") % 13).alias("yhat"))


@query("e11_regression_errors", with_(YHAT) + """
SELECT fold, round(1 - sum((y - yhat) * (y - yhat)) / (count(*) * var_pop(y)), 6) AS r2, round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse FROM yh GROUP BY 1""")
def e11(spark, sf):
    return round_all(metrics.regression_errors(_yhat(spark, sf), ["fold"]))


@query("e12_spearman", with_(YHAT) + """
, r AS (SELECT fold, rank() OVER (PARTITION BY fold ORDER BY y) + (count(*) OVER (PARTITION BY fold, y) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY fold ORDER BY yhat) + (count(*) OVER (PARTITION BY fold, yhat) - 1) / 2.0::DOUBLE AS b FROM yh)
SELECT fold, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def e12s(spark, sf):
    return round_all(metrics.spearman(_yhat(spark, sf), ["fold"]))


@query("e13_trapezoid_area", with_(SCORES) + """
SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6)::DOUBLE AS area FROM sc a, sc b WHERE a.label = 1 AND b.label = 0""")
def e13(spark, sf):
    return round_all(metrics.trapezoid_area(metrics.roc_curve(_points(spark, sf)), target_rows=100))


# ---- search tables ------------------------------------------------------------------------------

FOLDS = """
fo AS (SELECT 'c' || user_id AS candidate, 0 AS repeat, (event_id % 5)::INTEGER AS fold, CASE WHEN user_id % 10 <> 3 THEN avg(value) / 500 END AS pr_auc,
  CASE WHEN user_id % 10 <> 3 THEN avg(value) / 400 END AS roc_auc, CASE WHEN user_id % 10 = 3 THEN 'E' || (user_id % 4) END AS fit_error FROM events GROUP BY user_id, event_id % 5),
su AS (SELECT candidate, avg(pr_auc) AS mean_pr_auc, stddev_pop(pr_auc) AS std_pr_auc, max(pr_auc) - min(pr_auc) AS range_pr_auc, avg(roc_auc) AS mean_roc_auc,
  stddev_pop(roc_auc) AS std_roc_auc, min(fit_error) AS fit_error FROM fo GROUP BY 1)
"""


def _folds(spark, sf):
    e = table(spark, sf, "events")
    failed = F.col("user_id") % 10 == 3
    g = e.groupBy("user_id", (F.col("event_id") % 5).cast("int").alias("fold")).agg(F.avg("value").alias("v"))
    return g.select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("candidate"), F.lit(0).alias("repeat"), "fold",
        F.when(~failed, F.col("v") / 500).alias("pr_auc"), F.when(~failed, F.col("v") / 400).alias("roc_auc"),
        F.when(failed, F.concat(F.lit("E"), (F.col("user_id") % 4).cast("string"))).alias("fit_error"))


@query("h7_audit", with_(FOLDS) + """
SELECT count(*) AS n_total, count(*) - count(mean_pr_auc) AS n_failed, round(min(mean_pr_auc), 6) AS min, round(quantile_cont(mean_pr_auc, 0.25), 6) AS p25,
  round(median(mean_pr_auc), 6) AS median, round(quantile_cont(mean_pr_auc, 0.75), 6) AS p75, round(max(mean_pr_auc), 6) AS max, round(stddev_samp(mean_pr_auc), 6) AS std,
  round(max(mean_pr_auc) - min(mean_pr_auc), 6) AS spread FROM su""")
def h7(spark, sf):
    return round_all(search.audit(search.summarize_folds(_folds(spark, sf))))


@query("h7_failure_messages", with_(FOLDS) + "SELECT fit_error AS message, count(*) AS n_rows FROM su WHERE mean_pr_auc IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def h7m(spark, sf):
    return search.failure_messages(search.summarize_folds(_folds(spark, sf)))


@query("h8_leaderboard", with_(FOLDS) + "SELECT candidate, round(mean_pr_auc, 6) AS mean_pr_auc, round(std_pr_auc, 6) AS std_pr_auc FROM su WHERE mean_pr_auc IS NOT NULL ORDER BY su.mean_pr_auc DESC, candidate LIMIT 15")
def h8(spark, sf):
    return round_all(search.leaderboard(search.summarize_folds(_folds(spark, sf))).select("candidate", "mean_pr_auc", "std_pr_auc"))


OPERATING = with_(SCORES, G_POINTS, AUC_SQL, """
ff AS (SELECT *, 2 * p * r / greatest(p + r, 1e-12) AS f1, 5 * p * r / greatest(4 * p + r, 1e-12) AS f2 FROM pt),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate, repeat, fold ORDER BY round(f1, 12) DESC, t) AS k FROM ff) WHERE k = 1),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate, repeat, fold ORDER BY round(f2, 12) DESC, t) AS k FROM ff) WHERE k = 1),
sp AS (SELECT * FROM (SELECT candidate, repeat, fold, tp / pos AS rec, t, row_number() OVER (PARTITION BY candidate, repeat, fold ORDER BY tp DESC, t DESC NULLS FIRST) AS k
  FROM (SELECT candidate, repeat, fold, tp, fp, pos, neg, t FROM pt UNION ALL SELECT candidate, repeat, fold, 0, 0, pos, neg, NULL FROM nn) WHERE 1 - fp / neg >= 0.9) WHERE k = 1),
br AS (SELECT candidate, repeat, fold, avg((score - label) * (score - label)) AS brier FROM sc GROUP BY ALL)
""")


@query("h9_operating_points", OPERATING + """
SELECT candidate, repeat, fold, round(au.roc_auc, 6)::DOUBLE AS roc_auc, round(ap.pr_auc, 6) AS pr_auc, b1.t AS f1_threshold, round(b1.f1, 6) AS f1, round(b1.p, 6) AS f1_precision,
  round(b1.r, 6) AS f1_recall, b2.t AS f2_threshold, round(b2.f2, 6) AS f2, round(sp.rec, 6) AS recall_at_spec, sp.t AS spec_threshold, round(br.brier, 6) AS brier
FROM au JOIN ap USING (candidate, repeat, fold) JOIN b1 USING (candidate, repeat, fold) JOIN b2 USING (candidate, repeat, fold) JOIN sp USING (candidate, repeat, fold) JOIN br USING (candidate, repeat, fold)""")
def h9(spark, sf):
    return round_all(search.operating_points(scores(spark, sf), BY))


@query("g14_stability_table", OPERATING + """
SELECT candidate, round(avg(ap.pr_auc), 6) AS pr_mean, round(stddev_pop(ap.pr_auc), 6) AS pr_std, round(avg(au.roc_auc), 6)::DOUBLE AS roc_mean, round(stddev_pop(au.roc_auc), 6) AS roc_std,
  round(avg(br.brier), 6) AS brier_mean, round(stddev_pop(br.brier), 6) AS brier_std, round(avg(b1.t), 6) AS f1_threshold_mean, round(stddev_pop(b1.t), 6) AS f1_threshold_std,
  round(avg(sp.rec), 6) AS recall_at_spec_mean, round(stddev_pop(sp.rec), 6) AS recall_at_spec_std,
  round(avg(ap.pr_auc) - 0.5 * stddev_pop(ap.pr_auc) - 0.5 * avg(br.brier), 6) AS stability_score
FROM au JOIN ap USING (candidate, repeat, fold) JOIN b1 USING (candidate, repeat, fold) JOIN sp USING (candidate, repeat, fold) JOIN br USING (candidate, repeat, fold) GROUP BY candidate""")
def g14(spark, sf):
    return round_all(surrogate.stability_table(scores(spark, sf)))


@query("g1_meta_table", with_(FOLDS) + """
SELECT candidate, 'n' || (substr(candidate, 2)::BIGINT % 4) AS normalizer, round(mean_pr_auc, 6) AS mean_pr_auc, round(std_pr_auc, 6) AS std_pr_auc, round(range_pr_auc, 6) AS range_pr_auc,
  round(std_pr_auc / greatest(mean_pr_auc, 1e-6), 6) AS cv_pr_auc, round(mean_pr_auc - 0.5 * std_pr_auc, 6) AS uncertainty_aware_score FROM su WHERE mean_pr_auc IS NOT NULL""")
def g1(spark, sf):
    return round_all(_meta(spark, sf).select("candidate", "normalizer", "mean_pr_auc", "std_pr_auc", "range_pr_auc", "cv_pr_auc", "uncertainty_aware_score"))


def _candidates(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("candidate"), F.concat(F.lit("n"), (F.col("user_id") % 4).cast("string")).alias("normalizer"),
        F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("family"), (F.col("user_id") % 17 / 10.0).alias("rate"),
        F.when(F.col("user_id") % 6 != 0, F.col("user_id") % 11 * 1.0).alias("depth"))


CANDIDATES = """
ca AS (SELECT DISTINCT 'c' || user_id AS candidate, 'n' || (user_id % 4) AS normalizer, 'f' || (user_id % 3) AS family, (user_id % 17) / 10.0::DOUBLE AS rate,
  CASE WHEN user_id % 6 <> 0 THEN (user_id % 11)::DOUBLE END AS depth FROM events),
mt AS (SELECT ca.*, mean_pr_auc, mean_pr_auc - 0.5 * std_pr_auc AS uas FROM ca JOIN su USING (candidate) WHERE mean_pr_auc IS NOT NULL)
"""


def _meta(spark, sf):
    return surrogate.meta_table(_folds(spark, sf), _candidates(spark, sf))


@query("o2_top_survivors", with_(FOLDS, CANDIDATES) + "SELECT candidate, round(uas, 6) AS uncertainty_aware_score FROM mt ORDER BY uas DESC, candidate LIMIT 5")
def o2(spark, sf):
    return round_all(surrogate.top_survivors(_meta(spark, sf), 5).select("candidate", "uncertainty_aware_score"))


@query("g2_encoded_axes", with_(FOLDS, CANDIDATES) + """
SELECT candidate, (normalizer = 'n0')::INT::DOUBLE AS n0, (normalizer = 'n1')::INT::DOUBLE AS n1, (normalizer = 'n2')::INT::DOUBLE AS n2, (normalizer = 'n3')::INT::DOUBLE AS n3,
  rate, coalesce(depth, (SELECT median(depth) FROM mt)) AS depth FROM mt""")
def g2(spark, sf):
    meta = _meta(spark, sf)
    enc = surrogate.fit_encoder(meta, ["normalizer"], ["rate", "depth"])
    return meta.select("candidate", *[c.alias(n.split("=")[-1]) for c, n in zip(enc.columns(), enc.names)])


@query("g7_surface_grid", with_(FOLDS, CANDIDATES) + """
, b AS (SELECT min(rate) AS lr, max(rate) AS hr, min(depth) AS ld, max(depth) AS hd FROM mt), md AS (SELECT normalizer FROM mt GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT (i % 30)::INTEGER AS ia, (i // 30)::INTEGER AS ib, round(lr + (i % 30) * (hr - lr) / 29, 6) AS rate, round(ld + (i // 30) * (hd - ld) / 29, 6) AS depth, normalizer
FROM range(900) AS t(i), b, md""")
def g7(spark, sf):
    return round_all(surrogate.surface_grid(_meta(spark, sf), "rate", "depth", ["normalizer"], ["rate", "depth"]))


@query("g8_category_spread", with_(FOLDS, CANDIDATES) + """
, l AS (SELECT 'normalizer' AS axis, normalizer AS category, mean_pr_auc AS s FROM mt UNION ALL SELECT 'family', family, mean_pr_auc FROM mt)
SELECT axis, category, count(*) AS n, round(min(s), 6) AS min, round(quantile_cont(s, 0.25), 6) AS p25, round(median(s), 6) AS median, round(quantile_cont(s, 0.75), 6) AS p75,
  round(max(s), 6) AS max FROM l GROUP BY 1, 2""")
def g8(spark, sf):
    return round_all(surrogate.category_spread(_meta(spark, sf), ["normalizer", "family"], "mean_pr_auc"))


@query("g9_ensemble_spread", """
SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS mu, round(list_stddev_pop(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS sigma FROM embeddings""")
def g9(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("each"))
    return round_all(surrogate.spread_of(e, "each").select("vec_id", "mu", "sigma"))


@query("g10_acquisition", """
WITH a AS (SELECT event_id, value / 500 AS mu, (event_id % 20) / 100.0::DOUBLE AS sigma FROM events), b AS (SELECT max(mu) - 0.2 AS best FROM a),
z AS (SELECT *, greatest(sigma, 1e-9) AS s, mu - best - 0.001 AS g, (mu - best - 0.001) / greatest(sigma, 1e-9) AS z FROM a, b),
p AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) AS pdf, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
c AS (SELECT *, pdf * (0.319381530 * t - 0.356563782 * t * t + 1.781477937 * t * t * t - 1.821255978 * t * t * t * t + 1.330274429 * t * t * t * t * t) AS u FROM p)
SELECT event_id, round(mu + 1.5 * sigma, 6) AS ucb, round(g * CASE WHEN z >= 0 THEN 1 - u ELSE u END + s * pdf, 6) + 0.0 AS ei FROM c""")
def g10(spark, sf):
    a = table(spark, sf, "events").select("event_id", (F.col("value") / 500).alias("mu"), (F.col("event_id") % 20 / 100.0).alias("sigma"))
    best = a.agg(F.max("mu")).first()[0] - 0.2
    return round_all(a.select("event_id", surrogate.acquisition(F.col("mu"), F.col("sigma"), best).alias("ucb"),
                              surrogate.acquisition(F.col("mu"), F.col("sigma"), best, "ei").alias("ei")))


@query("g12_trust_region", with_(FOLDS, CANDIDATES) + """
, b AS (SELECT rate, depth FROM mt ORDER BY uas DESC, candidate LIMIT 1),
d AS (SELECT 'rate' AS name, 'lin' AS kind, 0.0::DOUBLE AS lo, 1.6::DOUBLE AS hi, rate AS v FROM b UNION ALL SELECT 'depth', 'log', 0.5, 20.0, depth FROM b UNION ALL SELECT 'size', 'int', 1, 9, NULL FROM b)
SELECT name, kind, round(CASE kind WHEN 'lin' THEN greatest(lo, v - 0.2 * (hi - lo)) WHEN 'log' THEN greatest(lo, CASE WHEN v > 0 THEN exp(ln(v) - 0.2 * (ln(hi) - ln(lo))) END) ELSE lo END, 6) AS lo,
  round(CASE kind WHEN 'lin' THEN least(hi, v + 0.2 * (hi - lo)) WHEN 'log' THEN least(hi, CASE WHEN v > 0 THEN exp(ln(v) + 0.2 * (ln(hi) - ln(lo))) END) ELSE hi END, 6) AS hi FROM d""")
def g12(spark, sf):
    best = surrogate.top_survivors(_meta(spark, sf), 1).first().asDict()  # an axis without a value, or a log axis at zero, keeps its bounds
    dims = spark.createDataFrame([(best["family"], "rate", "lin", 0.0, 1.6, None, None), (best["family"], "depth", "log", 0.5, 20.0, None, None),
                                  (best["family"], "size", "int", 1.0, 9.0, None, None)], search.DIMENSION_SCHEMA)
    return round_all(surrogate.trust_region(dims, {**best, "size": None}).select("name", "kind", "lo", "hi"))


# ---- candidate generation over a table's rows ---------------------------------------------------

LHS = """
pt AS (SELECT user_id % 3 AS family, event_id AS i FROM events), n AS (SELECT family, count(*) AS n FROM pt GROUP BY 1),
gr AS (SELECT family, name, i, md5('42:' || family || ':' || name || ':' || i) AS h FROM pt, (VALUES ('a'), ('b')) AS d(name)),
un AS (SELECT *, row_number() OVER (PARTITION BY family, name ORDER BY h, i) - 1 AS stratum, ('0x' || substr(md5('jitter:' || h), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS j FROM gr)
"""


def _lhs(spark, sf):
    points = table(spark, sf, "events").select((F.col("user_id") % 3).alias("family"), F.col("event_id").alias("i"))
    names = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name")
    dims = points.select("family").distinct().select("family", names)
    sized = points.join(points.groupBy("family").agg(F.count(F.lit(1)).alias("n")), "family")
    return search.latin_hypercube(sized, dims, F.col("n"), 42, ["family"])


@query("h1_latin_hypercube", with_(LHS) + "SELECT family, name, i, stratum, round((stratum + j) / n, 6) AS u FROM un JOIN n USING (family)")
def h1(spark, sf):
    return round_all(_lhs(spark, sf).select("family", "name", "i", "stratum", "u"))


@query("h2_unit_to_value", """
WITH u AS (SELECT event_id, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS u, (user_id % 6)::INT AS k FROM events)
SELECT event_id, round(CASE k WHEN 0 THEN 2 + u * 2 WHEN 1 THEN exp(ln(0.01) + u * (ln(0.3) - ln(0.01))) WHEN 2 THEN 2 + least(floor(u * 11), 10)
  WHEN 3 THEN round_even(exp(ln(100) + u * (ln(1000) - ln(100))), 0) WHEN 5 THEN CASE WHEN u >= 0.1 THEN 2 + least(floor((u - 0.1) / 0.9 * 23), 22) END END, 5) AS number,
  CASE WHEN k = 4 THEN ['l1', 'l2', 'l3'][(least(floor(u * 3), 2) + 1)::INT] END AS text FROM u""")
def h2(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("lin", "log", "int", "logint", "cat", "mix_int_none")])
    pick = lambda *v: F.get(F.array(*[F.lit(float(x)) for x in v]), F.col("k"))
    df = table(spark, sf, "events").select("event_id", (F.col("event_id") * 7919 % 1000 / 1000.0).alias("u"), (F.col("user_id") % 6).cast("int").alias("k"))
    number, text = search.map_unit(F.col("u"), F.get(kinds, F.col("k")), pick(2, 0.01, 2, 100, 0, 2), pick(4, 0.3, 12, 1000, 0, 24), F.lit(0.1),
                                   F.array(F.lit("l1"), F.lit("l2"), F.lit("l3")))
    return round_all(df.select("event_id", number.alias("number"), text.alias("text")), 5)


SPW = "sw AS (SELECT sum((o_orderstatus <> 'F')::INT)::DOUBLE / sum((o_orderstatus = 'F')::INT) AS base FROM orders)"


def _spw(spark, sf):
    from ..operators.split import positive_weight_base

    return positive_weight_base(orders(spark, sf), "label")


@query("h3_candidate_counts", with_(SPW) + """
, n AS (SELECT count(*) AS n FROM customer), o AS (SELECT * FROM (VALUES ('lgbm', 0.3, 17), ('rf', 0.1, 12), ('catboost', 0.1, 12), ('lr', 0.1, 10), ('stacker', 0.1, 11)) AS t(family, q, dims)),
c AS (SELECT family, round_even(q::DOUBLE * n, 0)::BIGINT AS n, dims FROM o, n)
SELECT family, n, dims::BIGINT AS dims, base > 0 AS in_range FROM (SELECT * FROM c UNION ALL SELECT 'xgb', (SELECT any_value(n.n) FROM n) - (SELECT sum(n) FROM c)::BIGINT, 17), sw""")
def h3(spark, sf):
    """As many candidates as there are customers."""
    base, total = _spw(spark, sf), table(spark, sf, "customer").count()
    values = search.candidate_values(spark, base, total)
    bounds = search.dimension_table(spark, base).select("family", "name", "lo", "hi")
    inside = F.coalesce(F.col("number").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9), F.lit(True))
    return values.join(bounds, ["family", "name"]).groupBy("family").agg(
        F.count_distinct("i").alias("n"), F.count_distinct("name").alias("dims"), F.every(inside).alias("in_range"))


@query("h4_diversity")
def h4(spark, sf):
    from ..operators.stats import normalized_entropy

    total = table(spark, sf, "customer").count()
    wide = search.candidate_table(search.candidate_values(spark, _spw(spark, sf), total))
    return normalized_entropy(wide, ["family", "imputer", "normalizer", "tamer__detector", "tamer__remediation", "selector", "balancer"])


@query("f14_config_labels", """
SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'knn(n_neighbors=5)' WHEN 1 THEN 'kbest(k=20)' WHEN 2 THEN 'smote(k_neighbors=3)' ELSE 'None' END AS label,
  CASE event_id % 3 WHEN 0 THEN 'xgb' WHEN 1 THEN 'stacker' ELSE 'plain' END AS family FROM events""")
def f14(spark, sf):
    option = F.get(F.array(F.lit("knn:5"), F.lit("kbest:20"), F.lit("smote:3"), F.lit(None)), (F.col("user_id") % 4).cast("int"))
    name = F.get(F.array(F.lit("XGBoostEstimator"), F.lit("CalibratedStack"), F.lit("Plain")), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf, "events").select("event_id", search.option_label(option).alias("label"), search.family_of(name).alias("family"))
