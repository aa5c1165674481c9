"""Neighbour joins and class balancing."""

from pyspark.sql import functions as F

from ..operators import balance, neighbors
from .bases import FULL_CUSTOMERS, full_customers, query, round_all, table, with_

XY = ["x", "y"]


def _near_sql(where="true", k=3, name="nn"):
    return f"""
{name}_a AS (SELECT q.row_id AS query_id, d.row_id AS neighbor_id, q.label AS ql, d.label AS dl, (q.x - d.x) * (q.x - d.x) + (q.y - d.y) * (q.y - d.y) AS d2
  FROM cust q JOIN cust d ON q.row_id <> d.row_id WHERE {where}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbor_id) AS rank FROM {name}_a) WHERE rank <= {k})
"""


@query("j8_cosine_top_k", """
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
p AS (SELECT q.vec_id AS query_id, d.vec_id AS neighbor_id, list_dot_product(q.e, d.e) / (q.n * d.n) AS score FROM u q JOIN u d ON q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, round(score, 5) AS score FROM r WHERE rank <= 5""")
def j8(spark, sf):
    e = table(spark, sf, "embeddings")
    return round_all(neighbors.cosine_top_k(e, e, "vec_id", "vec_id", "embedding", 64, 5, exclude_self=True), 5)


@query("j9_class_neighbours", with_(FULL_CUSTOMERS, _near_sql("q.label = 1 AND d.label = 1")) + """
SELECT query_id, rank::INTEGER AS rank, neighbor_id, round(sqrt(d2), 6) AS distance FROM nn""")
def j9(spark, sf):
    return round_all(balance.class_neighbours(full_customers(spark, sf), XY, "label", "row_id", 3, [1]))


@query("j9_neighbours_by_cells", with_(FULL_CUSTOMERS, _near_sql(k=4)) + """
SELECT query_id, rank::INTEGER AS rank, neighbor_id, round(sqrt(d2), 6) AS distance FROM nn""")
def j9c(spark, sf):
    """The plan for tables too large to broadcast, on the same rows."""
    df = full_customers(spark, sf)
    return round_all(neighbors.knn_join(df, df, XY, 4, block_rows=128, direct_rows=0))


@query("b1_identity", with_(FULL_CUSTOMERS) + "SELECT * FROM cust")
def b1(spark, sf):
    return balance.identity(full_customers(spark, sf))


COUNTS = """
, c AS (SELECT label, count(*) AS n FROM cust GROUP BY 1), m AS (SELECT max(n) AS big, min(n) AS small FROM c)
"""


def _counts(df):
    return df.groupBy("label", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


RAISED = with_(FULL_CUSTOMERS) + COUNTS + """
SELECT label, 0 AS is_synthetic, n FROM c UNION ALL SELECT label, 1, big - n FROM c, m WHERE n < big"""


@query("b2_smote_counts", RAISED)
def b2(spark, sf):
    return _counts(balance.smote(full_customers(spark, sf), XY, "label", "row_id", 3))


@query("b2_smote", None)
def b2r(spark, sf):
    return balance.smote(full_customers(spark, sf), XY, "label", "row_id", 3)


@query("b3_oversample", with_(FULL_CUSTOMERS) + """
, c AS (SELECT label, count(*) AS n FROM cust GROUP BY 1), m AS (SELECT max(n) AS big FROM c),
r AS (SELECT cust.*, c.n, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) AS k FROM cust JOIN c USING (label))
SELECT row_id, label, 1 + CASE WHEN n < big THEN (big - n) // n + (k <= (big - n) % n)::BIGINT ELSE 0 END AS copies FROM r, m""")
def b3(spark, sf):
    return balance.oversample(full_customers(spark, sf), "label", "row_id").groupBy("row_id", "label").agg(F.count(F.lit(1)).alias("copies"))


@query("b4_adasyn_quotas", with_(FULL_CUSTOMERS, _near_sql("q.label = 1")) + COUNTS + """
, r AS (SELECT query_id, sum((dl <> 1)::INT) / 3.0::DOUBLE AS ratio FROM nn GROUP BY 1)
SELECT query_id, round(ratio, 6) AS ratio, round_even(ratio / (SELECT sum(ratio) FROM r) * (SELECT (big - small)::DOUBLE FROM m), 0)::BIGINT AS quota FROM r""")
def b4(spark, sf):
    return round_all(balance.adasyn_quotas(full_customers(spark, sf), XY, "label", "row_id", 1, 3))


@query("b4_adasyn")
def b4r(spark, sf):
    return balance.adasyn(full_customers(spark, sf), XY, "label", "row_id", 3)


@query("b5_danger_rows", with_(FULL_CUSTOMERS, _near_sql("q.label = 1", 10)) + """
SELECT query_id, sum((dl <> 1)::INT)::BIGINT AS n_other FROM nn GROUP BY 1 HAVING sum((dl <> 1)::INT) * 2 >= 10 AND sum((dl <> 1)::INT) < 10""")
def b5(spark, sf):
    return balance.danger_rows(full_customers(spark, sf), XY, "label", "row_id", 1, 10)


@query("b5_borderline_smote", RAISED)
def b5r(spark, sf):
    return _counts(balance.borderline_smote(full_customers(spark, sf), XY, "label", "row_id", 3))


@query("b6_tomek_links", with_(FULL_CUSTOMERS, _near_sql(k=1)) + """
SELECT a.query_id AS left_id, a.neighbor_id AS right_id FROM nn a JOIN nn b ON a.query_id = b.neighbor_id AND a.neighbor_id = b.query_id
WHERE a.query_id < a.neighbor_id AND a.ql <> a.dl""")
def b6(spark, sf):
    return balance.tomek_links(full_customers(spark, sf), XY, "label", "row_id")


@query("b6_smote_tomek")
def b6r(spark, sf):
    return balance.smote_tomek(full_customers(spark, sf), XY, "label", "row_id")


@query("b7_edited_rows", with_(FULL_CUSTOMERS, _near_sql()) + "SELECT query_id FROM nn GROUP BY 1 HAVING bool_or(ql <> dl)")
def b7(spark, sf):
    return balance.edited_out(full_customers(spark, sf), XY, "label", "row_id", 3)


@query("b7_smote_enn")
def b7r(spark, sf):
    return balance.smote_enn(full_customers(spark, sf), XY, "label", "row_id")


@query("b8_undersample", with_(FULL_CUSTOMERS) + COUNTS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) AS k FROM cust) SELECT row_id, x, y, label FROM r, m WHERE k <= small""")
def b8(spark, sf):
    return balance.undersample(full_customers(spark, sf), "label", "row_id")
