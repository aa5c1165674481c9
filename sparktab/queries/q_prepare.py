"""Imputation, outlier taming, scaling, feature selection and report numbers."""

from pyspark.sql import functions as F

from ..operators import eda, impute, outlier, scale, select
from ..operators.stats import mad_scales
from .bases import (
    CUSTOMERS, FULL_CUSTOMERS, LINES, ORDERS, customers, full_customers, lines, orders, query, round_all, table, with_,
)

COLS = ["bal", "nat"]


def _fill_sql(mean, by=None):
    over = f" OVER (PARTITION BY {by})" if by else " OVER ()"
    own = [f"coalesce({c}, {mean}({c}){over}, {mean}({c}) OVER ())" for c in COLS]
    return with_(CUSTOMERS) + "SELECT row_id, " + ", ".join(f"round({o}, 6) AS {c}" for o, c in zip(own, COLS)) + " FROM cust"


def _out(df, places=6):
    return round_all(df.select("row_id", *COLS), places)


@query("i1_mean_impute", _fill_sql("avg"))
def i1(spark, sf):
    df = customers(spark, sf)
    return _out(impute.fit_mean(df, COLS).transform(df))


@query("i2_median_impute", _fill_sql("median"))
def i2(spark, sf):
    df = customers(spark, sf)
    return _out(impute.fit_median(df, COLS).transform(df))


@query("i3_class_mean_impute", _fill_sql("avg", "seg"))
def i3(spark, sf):
    df = customers(spark, sf)
    return _out(impute.fit_class_mean(df, COLS, "seg").transform_training(df))


@query("i3_class_mean_scoring", _fill_sql("avg"))
def i3b(spark, sf):
    df = customers(spark, sf)
    return _out(impute.fit_class_mean(df, COLS, "seg").transform(df.drop("seg")))


@query("i4_class_median_impute", _fill_sql("median", "seg"))
def i4(spark, sf):
    df = customers(spark, sf)
    return _out(impute.fit_class_median(df, COLS, "seg").transform_training(df))


@query("i8_chained_impute")
def i8(spark, sf):
    df = orders(spark, sf).withColumn("age", F.datediff(F.lit("2002-01-01").cast("date"), F.col("odate")).cast("double"))
    return impute.fit_chained(df, ["price", "cust", "age"]).transform(df).select("row_id", "price", "cust", "age")


KNN_COLS = ["bal", "nat", "size"]
KNN_BASE = """
k AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 1000.0 END AS bal, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey::DOUBLE END AS nat,
  CASE WHEN c_custkey % 3 <> 0 THEN length(c_mktsegment)::DOUBLE END AS size FROM customer)
"""


def _knn_base(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("row_id"), F.when(key % 7 != 0, F.col("c_acctbal") / 1000.0).alias("bal"), F.when(key % 5 != 0, F.col("c_nationkey").cast("double")).alias("nat"),
        F.when(key % 3 != 0, F.length("c_mktsegment").cast("double")).alias("size"))


def _knn_sql():
    d2 = "+".join(f"coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0)" for c in KNN_COLS)
    parts = []
    for c in KNN_COLS:
        shared = "+".join(f"(q.{o} IS NOT NULL AND d.{o} IS NOT NULL)::INT" for o in KNN_COLS if o != c)
        parts.append(f"""{c}_p AS (SELECT q.row_id, d.{c} AS v, row_number() OVER (PARTITION BY q.row_id ORDER BY ({d2.replace(f'coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0)', '0')}) * (3.0 / ({shared})), d.row_id) AS r
  FROM k q JOIN k d ON q.{c} IS NULL AND d.{c} IS NOT NULL WHERE ({shared}) > 0),
{c}_f AS (SELECT row_id, avg(v) AS v FROM {c}_p WHERE r <= 5 GROUP BY 1)""")
    fills = ", ".join(f"round(coalesce(k.{c}, {c}_f.v, (SELECT avg({c}) FROM k)), 5) AS {c}" for c in KNN_COLS)
    joins = " ".join(f"LEFT JOIN {c}_f ON {c}_f.row_id = k.row_id" for c in KNN_COLS)
    return with_(KNN_BASE, *parts) + f"SELECT k.row_id, {fills} FROM k {joins}"


@query("i9_knn_impute", _knn_sql())
def i9(spark, sf):
    df = _knn_base(spark, sf)
    return round_all(impute.fit_knn(df, KNN_COLS, "row_id", 5).transform(df), 5)


@query("i10_regression_impute", with_(CUSTOMERS) + """
, m AS (SELECT avg(bal) AS mb, avg(nat) AS mn FROM cust),
a AS (SELECT regr_slope(bal, coalesce(nat, mn)) AS s, regr_intercept(bal, coalesce(nat, mn)) AS i FROM cust, m WHERE bal IS NOT NULL),
b AS (SELECT regr_slope(nat, coalesce(bal, mb)) AS s, regr_intercept(nat, coalesce(bal, mb)) AS i FROM cust, m WHERE nat IS NOT NULL),
f AS (SELECT row_id, coalesce(bal, a.i + a.s * coalesce(nat, mn)) AS bal, nat FROM cust, m, a)
SELECT row_id, round(f.bal, 4) AS bal, round(coalesce(nat, b.i + b.s * f.bal), 4) AS nat FROM f, b""")
def i10(spark, sf):
    df = customers(spark, sf)
    return _out(impute.fit_regression(df, COLS).transform(df), 4)


# ---- outliers -----------------------------------------------------------------------------------

TAMED = with_(LINES) + """
, m AS (SELECT median(qty) AS mq, median(price) AS mp, median(tax) AS mt FROM li),
k AS (SELECT coalesce(nullif(median(abs(qty - mq)) * 1.4826, 0), 1) AS kq, coalesce(nullif(median(abs(price - mp)) * 1.4826, 0), 1) AS kp FROM li, m),
q AS (SELECT quantile_cont(qty, 0.01) AS lq, quantile_cont(qty, 0.99) AS hq, quantile_cont(price, 0.01) AS lp, quantile_cont(price, 0.99) AS hp FROM li),
z AS (SELECT li.*, abs((qty - mq) / kq) AS zq, abs((price - mp) / kp) AS zp, mq, mp, lq, hq, lp, hp, kq, kp FROM li, m, k, q)
"""


def _tamed(spark, sf, remediation, **options):
    df = lines(spark, sf).select("qty", "price")
    return outlier.OutlierTamer("statistical", remediation, mad_threshold=1.0, **options).fit(df, ["qty", "price"]).transform(df)


def _totals(df):
    """Row-level result condensed to value counts, which still covers every row."""
    return df.groupBy(F.round("qty", 4).alias("qty")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round("price", 2).cast("decimal(18,2)")).cast("double").alias("price"), F.round(F.min("price"), 4).alias("low"), F.round(F.max("price"), 4).alias("high"))


def _totals_sql(qty, price):
    return TAMED + f"""SELECT round(q, 4) AS qty, count(*) AS n, sum(round(p, 2)::DECIMAL(18,2))::DOUBLE AS price, round(min(p), 4) AS low, round(max(p), 4) AS high
FROM (SELECT {qty} AS q, {price} AS p FROM z) GROUP BY 1"""


@query("d4_winsorize", _totals_sql(
    "CASE WHEN zq > 1 AND qty < lq THEN lq WHEN zq > 1 AND qty > hq THEN hq ELSE qty END",
    "CASE WHEN zp > 1 AND price < lp THEN lp WHEN zp > 1 AND price > hp THEN hp ELSE price END"))
def d4(spark, sf):
    return _totals(_tamed(spark, sf, "winsorize"))


@query("d5_percentile_clip", _totals_sql("greatest(least(qty, hq), lq)", "greatest(least(price, hp), lp)"))
def d5(spark, sf):
    return _totals(_tamed(spark, sf, "percentile_clip"))


@query("d6_mad_replace", _totals_sql("CASE WHEN zq > 1 THEN mq ELSE qty END", "CASE WHEN zp > 1 THEN mp ELSE price END"))
def d6(spark, sf):
    return _totals(_tamed(spark, sf, "mad_replace"))


@query("d8_shrink", TAMED + """
, s AS (SELECT *, greatest(zq, zp) AS sc FROM z), b AS (SELECT min(sc) AS lo, max(sc) AS hi FROM s),
r AS (SELECT label, qty - 0.5 * ((sc - lo) / (hi - lo)) * (qty - mq) AS q, price - 0.5 * ((sc - lo) / (hi - lo)) * (price - mp) AS p, flag FROM s, b)
SELECT flag, label, count(*) AS n, round(avg(q), 5) AS qty, round(avg(p), 3) AS price, round(min(p), 3) AS low, round(max(p), 3) AS high FROM r GROUP BY 1, 2""")
def d8(spark, sf):
    df = lines(spark, sf).select("qty", "price", "flag", "label")
    out = outlier.OutlierTamer("statistical", "shrink").fit(df, ["qty", "price"]).transform(df)
    return out.groupBy("flag", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("qty"), 5).alias("qty"), F.round(F.avg("price"), 3).alias("price"),
        F.round(F.min("price"), 3).alias("low"), F.round(F.max("price"), 3).alias("high"))


@query("d9_fill_only", with_(CUSTOMERS) + "SELECT row_id, round(coalesce(bal, median(bal) OVER ()), 6) AS bal, round(coalesce(nat, median(nat) OVER ()), 6) AS nat FROM cust")
def d9(spark, sf):
    df = customers(spark, sf)
    return _out(outlier.OutlierTamer("statistical", "none").fit(df, COLS).transform(df))


CUST_Z = with_(CUSTOMERS) + """
, m AS (SELECT median(bal) AS mb, median(nat) AS mn FROM cust), f AS (SELECT row_id, seg, coalesce(bal, mb) AS bal, coalesce(nat, mn) AS nat, mb, mn FROM cust, m),
k AS (SELECT median(abs(bal - mb)) * 1.4826 AS kb, median(abs(nat - mn)) * 1.4826 AS kn FROM f),
z AS (SELECT f.*, (bal - mb) / kb AS zb, (nat - mn) / kn AS zn FROM f, k)
"""


@query("d1_statistical_score", CUST_Z + "SELECT row_id, round(greatest(abs(zb), abs(zn)), 6) AS score, (greatest(abs(zb), abs(zn)) > 1.2)::INTEGER AS flag FROM z")
def d1(spark, sf):
    df = customers(spark, sf)
    tamer = outlier.OutlierTamer("statistical", "none", z_threshold=1.2).fit(df, COLS)
    return round_all(tamer.score(df).select("row_id", "score", "flag"))


@query("d10_deviations", CUST_Z + "SELECT row_id, round(zb, 6) AS bal, round(zn, 6) AS nat FROM z")
def d10(spark, sf):
    df = customers(spark, sf)
    tamer = outlier.OutlierTamer("statistical", "none").fit(df, COLS)
    return round_all(tamer.score(df).select("row_id", *[d.alias(c) for c, d in tamer.deviations().items()]))


@query("d11_dominant_features", CUST_Z + """
, l AS (SELECT row_id, 'bal' AS feature, zb AS v FROM z WHERE greatest(abs(zb), abs(zn)) > 1.2 UNION ALL SELECT row_id, 'nat', zn FROM z WHERE greatest(abs(zb), abs(zn)) > 1.2)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY abs(v) DESC, feature)::INTEGER AS rank, feature, round(v, 6) AS signed_mad_z FROM l""")
def d11(spark, sf):
    df = customers(spark, sf)
    return round_all(outlier.OutlierTamer("statistical", "none", z_threshold=1.2).fit(df, COLS).explain(df, 3))


@query("d12_cluster_profile", CUST_Z + """
SELECT seg AS cluster, round(avg(abs(zb)), 6) AS bal, round(avg(abs(zn)), 6) AS nat, count(*) AS n_members,
  round(avg((greatest(abs(zb), abs(zn)) > 1.2)::INT), 6) AS flag_rate FROM z GROUP BY 1""")
def d12(spark, sf):
    df = customers(spark, sf)
    tamer = outlier.OutlierTamer("statistical", "none", z_threshold=1.2).fit(df, COLS)
    return round_all(outlier.cluster_profile(tamer.score(df).withColumnRenamed("seg", "cluster"), tamer.deviations()))


CENTRES = with_(FULL_CUSTOMERS) + """
, ct AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS c, x, y FROM (SELECT avg(x) AS x, avg(y) AS y FROM (SELECT x, y, ntile(3) OVER (ORDER BY y, row_id) AS t FROM cust) GROUP BY t)),
p AS (SELECT row_id, cust.x, cust.y, c, sqrt((cust.x - ct.x) * (cust.x - ct.x) + (cust.y - ct.y) * (cust.y - ct.y)) AS d FROM cust, ct),
b AS (SELECT row_id, x, y, d AS score, c::INTEGER AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, c) AS r FROM p) WHERE r = 1),
t AS (SELECT quantile_cont(score, 0.95) AS th FROM b)
"""


def _given_centres(spark, sf):
    """Centres by thirds of y, so that the check can state them."""
    df = full_customers(spark, sf)
    n = df.count()
    from ..operators.ordered import global_rank

    small, third = divmod(n, 3)
    keyed = df.withColumn("_k", F.format_string("%06d:%012d", F.col("y").cast("int"), F.col("row_id")))
    ranked = global_rank(keyed.withColumn("_o", F.col("y") * 1e10 + F.col("row_id")), "_o", "_r")
    first, second = small + (1 if third >= 1 else 0), 2 * small + min(third, 2)
    tile = F.when(F.col("_r") <= first, 1).when(F.col("_r") <= second, 2).otherwise(3)
    rows = ranked.groupBy(tile.alias("t")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect()
    centers = sorted([r["x"], r["y"]] for r in rows)
    return df, outlier.Clusters(["x", "y"], centers).calibrate(df, 0.05)


@query("d2_cluster_score", CENTRES + "SELECT row_id, round(score, 6) AS score, cluster, (score > th)::INTEGER AS flag FROM b, t")
def d2(spark, sf):
    df, clusters = _given_centres(spark, sf)
    return round_all(clusters.score(df).select("row_id", "score", "cluster", "flag"))


@query("a6_cluster_medians", CENTRES + "SELECT cluster, round(median(x), 6) AS x, round(median(y), 6) AS y, count(*) AS n, round(avg((score > th)::INT), 6) AS flag_rate FROM b, t GROUP BY 1")
def a6(spark, sf):
    df, clusters = _given_centres(spark, sf)
    meds = spark.createDataFrame([(c, v["x"], v["y"]) for c, v in clusters.medians.items()], "cluster int, x double, y double")
    sizes = clusters.score(df).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("flag").alias("flag_rate"))
    return round_all(meds.join(sizes, "cluster"))


@query("d7_cluster_local_median", CENTRES + """
, g AS (SELECT median(x) AS mx, median(y) AS my FROM cust), k AS (SELECT median(abs(x - mx)) * 1.4826 AS kx, median(abs(y - my)) * 1.4826 AS ky FROM cust, g),
lm AS (SELECT cluster, median(x) AS lx, median(y) AS ly FROM b GROUP BY 1)
SELECT row_id, round(CASE WHEN abs((x - mx) / kx) > 1 THEN lx ELSE x END, 6) AS x, round(CASE WHEN abs((y - my) / ky) > 1 THEN ly ELSE y END, 6) AS y FROM b JOIN lm USING (cluster), g, k""")
def d7(spark, sf):
    df, clusters = _given_centres(spark, sf)
    tamer = outlier.OutlierTamer("statistical", "mad_replace", mad_threshold=1.0).fit(df, ["x", "y"])
    tamer.remediation, tamer.state.clusters = "cluster_local_median", clusters
    return round_all(tamer.transform(df).select("row_id", "x", "y"))


@query("d2_kmeans_tame")
def d2k(spark, sf):
    df = full_customers(spark, sf)
    return outlier.OutlierTamer("cluster", "cluster_local_median").fit(df, ["x", "y"]).transform(df)


@query("d3_isolation_forest")
def d3(spark, sf):
    df = full_customers(spark, sf)
    return outlier.OutlierTamer("iforest", "none").fit(df, ["x", "y"]).score(df)


# ---- scalers ------------------------------------------------------------------------------------


def _scaled(spark, sf, fit):
    df = customers(spark, sf).withColumn("one", F.lit(3.0))
    return round_all(fit(df, [*COLS, "one"]).transform(df).select("row_id", *COLS, "one"))


@query("n1_minmax", with_(CUSTOMERS) + """
SELECT row_id, round((bal - min(bal) OVER ()) / (max(bal) OVER () - min(bal) OVER ()), 6) AS bal, round((nat - min(nat) OVER ()) / (max(nat) OVER () - min(nat) OVER ()), 6) AS nat, 0.0::DOUBLE AS one FROM cust""")
def n1(spark, sf):
    return _scaled(spark, sf, scale.fit_minmax)


@query("n2_robust", with_(CUSTOMERS) + """
, s AS (SELECT median(bal) AS mb, quantile_cont(bal, 0.75) - quantile_cont(bal, 0.25) AS sb, median(nat) AS mn, quantile_cont(nat, 0.75) - quantile_cont(nat, 0.25) AS sn FROM cust)
SELECT row_id, round((bal - mb) / sb, 6) AS bal, round((nat - mn) / sn, 6) AS nat, 0.0::DOUBLE AS one FROM cust, s""")
def n2(spark, sf):
    return _scaled(spark, sf, scale.fit_robust)


@query("n3_zscore", with_(CUSTOMERS) + """
SELECT row_id, round((bal - avg(bal) OVER ()) / stddev_pop(bal) OVER (), 6) AS bal, round((nat - avg(nat) OVER ()) / stddev_pop(nat) OVER (), 6) AS nat, 0.0::DOUBLE AS one FROM cust""")
def n3(spark, sf):
    return _scaled(spark, sf, scale.fit_zscore)


@query("n4_power_likelihood", with_(LINES) + """
, g AS (SELECT unnest([-1.0, -0.5, 0.5, 1.0, 1.5, 2.5])::DOUBLE AS lam),
t AS (SELECT lam, (pow(qty + 1, lam) - 1) / lam AS v, qty FROM li, g)
SELECT lam, round(-count(*) / 2.0 * ln(var_pop(v)) + (lam - 1) * sum(ln(qty + 1)), 3) AS loglik FROM t GROUP BY lam""")
def n4a(spark, sf):
    grid = [-1.0, -0.5, 0.5, 1.0, 1.5, 2.5]
    found = scale.power_loglik(lines(spark, sf), {"qty": grid})
    return round_all(spark.createDataFrame([(l, found[("qty", l)]) for l in grid], "lam double, loglik double"), 3)


@query("n4_power_transform")
def n4b(spark, sf):
    df = customers(spark, sf)
    return scale.fit_power(df, COLS).transform(df).select("row_id", *COLS)


# ---- feature selection --------------------------------------------------------------------------

ANOVA_SQL = """
WITH l AS (SELECT l_linestatus AS g, 'qty' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT l_linestatus, 'price', l_extendedprice FROM lineitem UNION ALL
  SELECT l_linestatus, 'disc', l_discount FROM lineitem UNION ALL SELECT l_linestatus, 'tax', l_tax FROM lineitem UNION ALL
  SELECT l_linestatus, 'key', l_orderkey::DOUBLE FROM lineitem),
t AS (SELECT c, avg(v) AS a, count(*) AS n FROM l GROUP BY 1),
s AS (SELECT c, g, count(*) AS n, avg(v) AS m, sum(v * v) - count(*) * avg(v) * avg(v) AS w FROM l GROUP BY 1, 2),
f AS (SELECT s.c, (sum(s.n * (m - a) * (m - a)) / (count(*) - 1)) / (sum(w) / (any_value(t.n) - count(*))) AS f FROM s JOIN t USING (c) GROUP BY s.c)
"""


def _anova(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("g"))


@query("l1_anova_f", ANOVA_SQL + 'SELECT c AS "column", round(f, 4) AS f_value FROM f')
def l1(spark, sf):
    return round_all(select.anova_f(_anova(spark, sf), ["qty", "price", "disc", "tax", "key"], "g"), 4)


@query("l1_select_k_best", ANOVA_SQL + 'SELECT c AS "column" FROM f ORDER BY f DESC LIMIT 2')
def l1k(spark, sf):
    kept = select.select_k_best(_anova(spark, sf), ["qty", "price", "disc", "tax", "key"], "g", 2)
    return spark.createDataFrame([(c,) for c in kept], "column string")


# ---- report numbers -----------------------------------------------------------------------------

X1_SQL = with_(LINES) + """
, l AS (SELECT 'qty' AS c, qty AS v FROM li UNION ALL SELECT 'price', price FROM li UNION ALL SELECT 'tax', tax FROM li),
s AS (SELECT c, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1)
SELECT l.c AS "column", least(floor((v - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, count(*) AS n, round(any_value(lo + least(floor((v - lo) / ((hi - lo) / 30)), 29) * ((hi - lo) / 30)), 4) AS low,
  round(any_value(lo + (least(floor((v - lo) / ((hi - lo) / 30)), 29) + 1) * ((hi - lo) / 30)), 4) AS high FROM l JOIN s USING (c) GROUP BY 1, 2"""


@query("x1_histograms", X1_SQL)
def x1(spark, sf):
    return round_all(eda.histograms(lines(spark, sf), ["qty", "price", "tax"]), 4)


CORR = ["qty", "price", "disc", "label"]


@query("a10_correlation_matrix", with_(LINES) + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS r, count(*) AS n FROM li" for a in CORR for b in CORR))
def a10(spark, sf):
    return round_all(eda.correlation_matrix(lines(spark, sf), CORR))


X4 = ["price", "cust", "label"]


@query("x4_correlation_test", with_(ORDERS) + """
, l AS (SELECT 'price' AS feature, corr(price, label) AS r, count(price) AS n FROM ord UNION ALL SELECT 'cust', corr(cust, label), count(cust) FROM ord)
SELECT feature, round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t_value FROM l""")
def x4(spark, sf):
    found = eda.p_values(orders(spark, sf), ["price", "cust"], "label")
    return found.select("feature", F.round("r", 6).alias("r"), "n", F.round("t_value", 5).alias("t_value"))


@query("x4_p_values")
def x4p(spark, sf):
    return eda.p_values(orders(spark, sf), ["price", "cust"], "label")


@query("x5_p_value_lines")
def x5(spark, sf):
    return eda.p_value_report(eda.p_values(orders(spark, sf), ["price", "cust"], "label")).select("line")
