"""Random trees over all line items, drawn and grown again by the check SQL, and the spread of their predictions."""

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import boosting, random_trees
from ..plans import surrogate
from .bases import query, round_all, table

NAMES = ["l_quantity", "l_discount", "l_tax"]
TREES, DEPTH, SEED, LEAST = 3, 4, 42, 20


def replay(result: str) -> str:
    """SQL that grows all trees level by level from the same digests; ``result`` reads ``inner_nodes``, the rows ``r`` and the values of leaves."""
    prime = random_trees.PRIME
    draw = f"(key * 48271 + j + 1) % {prime}"
    for shift, factor in ((15, 69_621), (13, 48_271)):
        draw = f"list_transform([{draw}], lambda h: (xor(h, h >> {shift}) * {factor}) % {prime})[1]"
    columns = "unnest([0, 1, 2]) AS j, unnest([v0, v1, v2]) AS v"
    sql = [f"""
WITH r0 AS (SELECT i, nr, tree, '' AS path, (({SEED} * 1000003 + tree) % {prime} * 48271 + 11) % {prime} AS key, y, v0, v1, v2
  FROM (SELECT row_number() OVER () AS nr, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS i, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS v0, l_discount::DOUBLE AS v1, l_tax::DOUBLE AS v2 FROM lineitem),
  (SELECT unnest(range({TREES})) AS tree)),
ev AS (SELECT DISTINCT {columns} FROM r0 WHERE tree = 0),"""]
    for k in range(DEPTH):
        sql.append(f"""
l{k} AS (SELECT tree, path, key, y, {columns} FROM r{k} WHERE length(path) = {k}),
b{k} AS (SELECT tree, path, key, j, min(v) AS lo, max(v) AS hi, sum(y) AS ty, count(*) AS tn FROM l{k} GROUP BY ALL HAVING min(v) < max(v)),
d{k} AS (SELECT *, lo + {draw} / {prime}::DOUBLE * (hi - lo) AS t FROM b{k}),
s{k} AS (SELECT d.tree, d.path, d.key, d.j, d.t, any_value(ty) AS ty, any_value(tn) AS tn, sum(y) FILTER (v <= t) AS ly, count(*) FILTER (v <= t) AS ln
  FROM d{k} d JOIN l{k} l ON l.tree = d.tree AND l.path = d.path AND l.j = d.j GROUP BY ALL),
x{k} AS (SELECT *, ly * ly / ln + (ty - ly) * (ty - ly) / (tn - ln) - ty * ty / tn AS gain FROM s{k} WHERE ln >= {LEAST} AND tn - ln >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY tree, path ORDER BY gain DESC, j) = 1),
r{k + 1} AS (SELECT r.i, r.nr, r.tree, CASE WHEN x.path IS NULL THEN r.path WHEN goes THEN r.path || 'L' ELSE r.path || 'R' END AS path,
    CASE WHEN x.path IS NULL THEN r.key ELSE (r.key * 69621 + CASE WHEN goes THEN 17 ELSE 29 END) % {prime} END AS key, y, v0, v1, v2
  FROM (SELECT r.*, x.path AS xp, CASE x.j WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END <= x.t AS goes FROM r{k} r LEFT JOIN x{k} x ON x.tree = r.tree AND x.path = r.path) r
  LEFT JOIN x{k} x ON x.tree = r.tree AND x.path = r.path),""")
    inner = " UNION ALL ".join(f"SELECT x.tree, x.path, x.j, x.t FROM x{k} x" for k in range(DEPTH))
    sql.append(f"""
inner_nodes AS (SELECT n.tree, n.path, n.j, max(e.v) AS cut FROM ({inner}) n JOIN ev e ON e.j = n.j AND e.v <= n.t GROUP BY n.tree, n.path, n.j),
leaves AS (SELECT tree, path, avg(y) AS value, count(*) AS n_rows FROM r{DEPTH} GROUP BY tree, path){result}""")
    return "".join(sql)


def _fitted(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row_id"), F.col("l_extendedprice").cast("double").alias("y"),
        F.array(*(F.col(n).cast("double") for n in NAMES)).alias("x"))
    spec = random_trees.random_spec(TREES, DEPTH, LEAST, SEED)
    return items, random_trees.fit_random_trees(items, F.col("x"), F.col("y"), "row_id", [boosting.Run(spec)])[0]


@query("g9_random_trees", replay(f"""
SELECT tree, path, ['l_quantity', 'l_discount', 'l_tax'][j + 1] AS feature, cut, NULL::BIGINT AS n_rows, NULL::DOUBLE AS log_value FROM inner_nodes UNION ALL
SELECT tree, path, NULL, NULL, n_rows, round(ln(value), 6) FROM leaves"""))
def g9_trees(spark, sf):
    _, model = _fitted(spark, sf)
    rows = []
    for k, tree in enumerate(model.trees):
        line = [(0, "")]
        for node, path in line:
            inner = tree.feature[node] >= 0
            mean = tree.value[node] * len(model.trees) + model.start
            rows.append((k, path, NAMES[tree.feature[node]] if inner else None, tree.cut[node] if inner else None, None if inner else tree.rows[node], None if inner else math.log(mean)))
            if inner:
                line += [(tree.left[node], path + "L"), (tree.right[node], path + "R")]
    return round_all(spark.createDataFrame(rows, "tree long, path string, feature string, cut double, n_rows long, log_value double"), 6)


@query("g9_tree_spread", replay(f"""
SELECT r.i AS row_id, round(avg(value)) AS mu, round(stddev_pop(value)) AS sigma FROM r{DEPTH} r JOIN leaves USING (tree, path) GROUP BY r.nr, r.i"""))
def g9_spread(spark, sf):
    items, model = _fitted(spark, sf)
    return round_all(surrogate.tree_spread(items.withColumn("features", array_to_vector("x")), surrogate.BoostedModel(model), ["row_id"]), 0)
