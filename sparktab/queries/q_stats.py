"""Aggregates, ordered operators, top-k and set operators."""

from pyspark.sql import functions as F

from ..functions.text import dedup_key, token_similarity
from ..operators import impute, metrics, ordered, quantiles, split, stats
from ..plans import surrogate
from .bases import CUSTOMERS, EVENTS, LINES, ORDERS, SCORES, customers, events, lines, orders, query, round_all, scores, table, with_


@query("a1_value_shares", "SELECT event_type, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS share FROM events GROUP BY 1")
def a1(spark, sf):
    return round_all(stats.value_shares(table(spark, sf, "events"), "event_type"))


@query("a2_class_mean_median", with_(CUSTOMERS) + """
SELECT seg, round(avg(bal), 6) AS mean_bal, round(avg(nat), 6) AS mean_nat, round(median(bal), 6) AS bal, round(median(nat), 6) AS nat FROM cust GROUP BY seg""")
def a2(spark, sf):
    df = customers(spark, sf)
    means = df.groupBy("seg").agg(F.avg("bal").alias("mean_bal"), F.avg("nat").alias("mean_nat"))
    return round_all(means.join(quantiles.group_quantiles(df, ["seg"], {"bal": ("bal", 0.5), "nat": ("nat", 0.5)}), "seg"))


A3_SQL = with_(LINES) + """
SELECT c AS "column", prob::DOUBLE AS prob, round(v, 6)::DOUBLE AS value FROM (
  SELECT 'qty' AS c, unnest([0.01, 0.25, 0.5, 0.95, 0.99]) AS prob, unnest(quantile_cont(qty, [0.01, 0.25, 0.5, 0.95, 0.99])) AS v FROM li UNION ALL
  SELECT 'price', unnest([0.01, 0.25, 0.5, 0.95, 0.99]), unnest(quantile_cont(price, [0.01, 0.25, 0.5, 0.95, 0.99])) FROM li UNION ALL
  SELECT 'disc', unnest([0.01, 0.25, 0.5, 0.95, 0.99]), unnest(quantile_cont(disc, [0.01, 0.25, 0.5, 0.95, 0.99])) FROM li)"""


def _quantile_table(spark, sf, max_values):
    probs = [0.01, 0.25, 0.5, 0.95, 0.99]
    found = quantiles.quantiles(lines(spark, sf), {c: (F.col(c), probs) for c in ("qty", "price", "disc")}, max_values)
    rows = [(c, p, v) for c, vs in found.items() for p, v in zip(probs, vs)]
    return round_all(spark.createDataFrame(rows, "column string, prob double, value double"))


@query("a3_quantiles", A3_SQL)
def a3(spark, sf):
    return _quantile_table(spark, sf, quantiles.MAX_BUFFERED_VALUES)


@query("a3_quantiles_bracketed", A3_SQL)
def a3b(spark, sf):
    """The plan used past one aggregation buffer, on the same table."""
    return _quantile_table(spark, sf, 100)


@query("a4_mad_scale", with_(LINES) + """
, m AS (SELECT median(qty) AS q, median(price) AS p FROM li)
SELECT 'qty' AS "column", round(median(abs(qty - q)) * 1.4826, 6) AS mad FROM li, m UNION ALL SELECT 'price', round(median(abs(price - p)) * 1.4826, 6) FROM li, m
UNION ALL SELECT 'one', 1.0""")
def a4(spark, sf):
    df = lines(spark, sf).withColumn("one", F.lit(5.0))
    meds = quantiles.medians(df, ["qty", "price", "one"])
    return round_all(spark.createDataFrame(list(stats.mad_scales(df, meds).items()), "column string, mad double"))


@query("a5_distinct_counts", """
SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type, count(DISTINCT value) AS value FROM events""")
def a5(spark, sf):
    return table(spark, sf, "events").agg(*[F.count_distinct(c).alias(c) for c in ("user_id", "event_type", "value")])


@query("a7_describe", with_(ORDERS) + "\n".join(f"""
{'UNION ALL' if i else ''} SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min,
  round(quantile_cont({c}, 0.25), 4) AS p25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM ord"""
                                              for i, c in enumerate(("price", "cust"))))
def a7(spark, sf):
    return round_all(stats.describe(orders(spark, sf), ["price", "cust"]), 4)


@query("a8_fold_summary", with_(EVENTS) + """
, f AS (SELECT user_id AS candidate, (row_id % 5)::INT AS fold, avg(value) AS v FROM ev GROUP BY 1, 2)
SELECT candidate, round(avg(v), 6) AS mean_v, round(stddev_pop(v), 6) AS std_v, round(max(v) - min(v), 6) AS range_v FROM f GROUP BY 1""")
def a8(spark, sf):
    folds = events(spark, sf).groupBy(F.col("user_id").alias("candidate"), (F.col("row_id") % 5).alias("fold")).agg(F.avg("value").alias("v"))
    return round_all(stats.fold_summary(folds, ["candidate"], ["v"]))


@query("a9_entropy", with_(ORDERS) + """
, l AS (SELECT 'prio' AS axis, prio AS v FROM ord UNION ALL SELECT 'status', status FROM ord UNION ALL SELECT 'same', 'x' FROM ord UNION ALL
  SELECT 'rare', CASE WHEN row_id % 50 = 0 THEN 'a' ELSE 'b' END FROM ord),
c AS (SELECT axis, v, count(*) AS c FROM l GROUP BY 1, 2), t AS (SELECT axis, sum(c) AS n, count(*) AS k FROM c GROUP BY 1),
h AS (SELECT axis, t.n::BIGINT AS n, t.k, CASE WHEN k = 1 THEN 0.0 ELSE -sum(c / n * ln(c / n)) / ln(k) END AS h FROM c JOIN t USING (axis) GROUP BY axis, n, k)
SELECT axis, n, k, round(h, 6) AS entropy, h < 0.8 AS is_low FROM h""")
def a9(spark, sf):
    df = orders(spark, sf).withColumn("same", F.lit("x")).withColumn("rare", F.when(F.col("row_id") % 50 == 0, "a").otherwise("b"))
    return round_all(stats.normalized_entropy(df, ["prio", "status", "same", "rare"]))


@query("a11_ordered_distinct", with_(EVENTS) + """
, f AS (SELECT user_id, etype, min(row_id) AS p FROM ev GROUP BY 1, 2)
SELECT user_id, string_agg(etype, ',' ORDER BY p) AS kinds FROM f GROUP BY 1""")
def a11(spark, sf):
    found = stats.ordered_distinct(events(spark, sf), ["user_id"], "etype", "row_id", "kinds")
    return found.select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("a12_modal_value", "SELECT p_size, count(*) AS n_rows FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def a12(spark, sf):
    return stats.modal_value(table(spark, sf, "part"), "p_size")


@query("a14_top_messages", """
SELECT substring(text, 1, 240) AS message, count(*) AS n_rows FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def a14(spark, sf):
    return stats.top_messages(table(spark, sf, "documents"), "text")


# ---- ordered operators --------------------------------------------------------------------------

FILL_SQL = with_(EVENTS) + """
, w AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS p,
  first_value(value IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM ev)
SELECT row_id, coalesce({order}) AS value FROM w"""


@query("w1_forward_fill", FILL_SQL.format(by="user_id", order="p, n"))
def w1(spark, sf):
    return impute.forward_fill(events(spark, sf).select("row_id", "user_id", "value"), "row_id", ["value"], ["user_id"]).select("row_id", "value")


@query("w1_forward_fill_whole", FILL_SQL.format(by="1", order="p, n"))
def w1b(spark, sf):
    """No partition column: buckets of the order key keep the work spread."""
    return impute.forward_fill(events(spark, sf).select("row_id", "value"), "row_id", ["value"], target_rows=300)


@query("w2_backward_fill", FILL_SQL.format(by="user_id", order="n, p"))
def w2(spark, sf):
    return impute.backward_fill(events(spark, sf).select("row_id", "user_id", "value"), "row_id", ["value"], ["user_id"], target_rows=300).select("row_id", "value")


INTERPOLATE_SQL = with_(EVENTS) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY row_id) AS pos FROM ev),
w AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp, last_value(value IGNORE NULLS) OVER b AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np, first_value(value IGNORE NULLS) OVER a AS nv FROM r
  WINDOW b AS (PARTITION BY {by} ORDER BY row_id ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY {by} ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT row_id, round(coalesce(value, CASE WHEN np > pp THEN pv + (nv - pv) * (pos - pp) / (np - pp) END, pv, nv), 6) AS value FROM w"""


@query("w3_interpolate", INTERPOLATE_SQL.format(by="user_id"))
def w3(spark, sf):
    df = events(spark, sf).select("row_id", "user_id", "value")
    return round_all(impute.interpolate(df, "row_id", ["value"], ["user_id"]).select("row_id", "value"))


@query("w3_interpolate_whole", INTERPOLATE_SQL.format(by="1"))
def w3b(spark, sf):
    return round_all(impute.interpolate(events(spark, sf).select("row_id", "value"), "row_id", ["value"], target_rows=300))


@query("w7_mid_ranks", """
SELECT p_size, count(*) AS n, (SELECT count(*) FROM part b WHERE b.p_size < a.p_size) + (count(*) + 1) / 2.0::DOUBLE AS mid_rank FROM part a GROUP BY p_size""")
def w7(spark, sf):
    return ordered.mid_ranks(table(spark, sf, "part"), "p_size")


@query("w8_stratified_folds", with_(ORDERS) + """
SELECT row_id, ((row_number() OVER (PARTITION BY status ORDER BY md5('42:' || row_id), row_id) - 1) % 5)::INTEGER AS fold FROM ord""")
def w8(spark, sf):
    return split.stratified_folds(orders(spark, sf).select("row_id", "status"), "status", "row_id", 5, 42).select("row_id", "fold")


@query("h5_stratified_holdout", with_(ORDERS) + """
, r AS (SELECT row_id, row_number() OVER (PARTITION BY status ORDER BY md5('42:' || row_id), row_id) AS k, count(*) OVER (PARTITION BY status) AS n FROM ord)
SELECT row_id, k <= floor(n * 0.2 + 0.5) AS is_holdout FROM r""")
def h5(spark, sf):
    df = orders(spark, sf).select("row_id", "status")
    return split.stratified_holdout(df, "status", "row_id", 0.2, 42, target_rows=500).select("row_id", "is_holdout")


@query("m9_class_weights", """
SELECT o_orderstatus AS status, count(*) AS n_rows, round((SELECT count(*) FROM orders) / (3.0 * count(*)), 6) AS weight FROM orders GROUP BY 1""")
def m9(spark, sf):
    return round_all(split.class_weights(orders(spark, sf), "status"))


# ---- top-k --------------------------------------------------------------------------------------


@query("o3_best_row", "SELECT user_id, arg_max(event_id, struct_pack(v := value, k := -event_id)) AS event_id, max(value) AS value FROM events GROUP BY 1")
def o3(spark, sf):
    best = F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id"))).alias("b")
    return table(spark, sf, "events").groupBy("user_id").agg(best).select("user_id", "b.event_id", "b.value")


QUOTA_SQL = """
WITH c AS (SELECT event_id, event_type AS family, (user_id % 7)::VARCHAR AS selector, (user_id % 3)::VARCHAR AS balancer, value AS acq FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY acq DESC, event_id) <= 4 AS f,
  row_number() OVER (PARTITION BY selector ORDER BY acq DESC, event_id) <= 2 AS s, row_number() OVER (PARTITION BY balancer ORDER BY acq DESC, event_id) <= 2 AS b FROM c)
SELECT event_id, family, selector, balancer, acq FROM r ORDER BY f DESC, s::INT + b::INT DESC, acq DESC, event_id LIMIT 40"""


@query("o7_quota_top_k", QUOTA_SQL)
def o7(spark, sf):
    c = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("family"), (F.col("user_id") % 7).cast("string").alias("selector"),
        (F.col("user_id") % 3).cast("string").alias("balancer"), F.col("value").alias("acq"))
    return surrogate.select_with_quotas(c, "acq", 40, {"family": 0.10, "selector": 0.05, "balancer": 0.05}, "event_id")


# ---- sets ---------------------------------------------------------------------------------------


@query("u1_union_by_name", """
SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg, '-1' AS _batch FROM customer UNION ALL
SELECT s_suppkey, s_acctbal, NULL, '0' FROM supplier""")
def u1(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    more = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return surrogate.append_batch(base, more, "0")


@query("u3_token_similarity", """
WITH p AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type) || ' ring ' || split_part(p_name, ' ', 1), ' ')) AS b FROM part),
s AS (SELECT p_partkey, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM p)
SELECT p_partkey, round(0.65 * i / (na + nb - i) + 0.35 * i / least(na, nb), 6) AS similarity FROM s""")
def u3(spark, sf):
    other = F.concat_ws(" ", F.lower("p_type"), F.lit("ring"), F.split("p_name", " ")[0])
    return round_all(table(spark, sf, "part").select("p_partkey", token_similarity(F.lower("p_name"), other).alias("similarity")))


@query("u5_duplicate_texts", """
SELECT key, count(*) AS n FROM (SELECT lower(trim(regexp_replace(p_name || '  ' || p_brand, '\\s+', ' ', 'g'))) AS key FROM part) GROUP BY 1 HAVING count(*) > 1""")
def u5(spark, sf):
    keyed = table(spark, sf, "part").select(dedup_key(F.concat("p_name", F.lit("  "), "p_brand")).alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
