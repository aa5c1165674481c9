"""Boosted trees over all line items, replayed by the check SQL: same splits, gains, sums and leaf values."""

from pyspark.sql import functions as F

from ..operators import boosting
from ..operators.encode import ordered_target_statistics
from .bases import ORDERS, orders, query, round_all, table, with_

NAMES = ["l_quantity", "l_discount", "l_tax"]
TABLE_SCHEMA = "path string, feature string, cut double, gain double, n_rows long, grad double, hess double, value double"


def _fitted(spark, sf, spec, second: float):
    items = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row_id"), (F.col("l_returnflag") == "N").cast("int").alias("y"),
        F.array(*(F.when((F.col("l_partkey") % 9 != 0) | F.lit(n != "l_tax"), F.col(n)) for n in NAMES)).alias("x"))
    weight = F.when(F.col("y") == 1, F.lit(second)).otherwise(F.lit(1.0))
    return boosting.fit_boosters(items, F.col("x"), F.col("y"), "row_id", [boosting.Run(spec, weight)])[0]


def _first_tree(spark, model):
    """The nodes of the first tree by their path from the root."""
    tree, rows = model.trees[0], []
    line = [(0, "")]
    for node, path in line:
        inner = tree.feature[node] >= 0
        if not tree.rows[node]:
            continue  # symmetric trees split empty nodes too
        rows.append((
            path, NAMES[tree.feature[node]] if inner else None, tree.cut[node] if inner else None, tree.gain[node] if inner else None, tree.rows[node],
            tree.grad[node], tree.hess[node], None if inner else tree.value[node]))
        if inner:
            line += [(tree.left[node], path + "L"), (tree.right[node], path + "R")]
    return round_all(spark.createDataFrame(rows, TABLE_SCHEMA), 4)


def replay(kind: str, steps: int, second: float, l1: float, l2: float, gamma: float, min_hessian: float, min_rows: int, rate: float, p: str = "0.5") -> str:
    """SQL that grows the first tree step by step: a level of all nodes, the best leaf alone, or one split for all nodes of a level."""
    worth = lambda g, h: f"(CASE WHEN {h} + {l2} > 0 THEN pow(greatest(abs({g}) - {l1}, 0), 2) / ({h} + {l2}) ELSE 0 END)"
    sql = [f"""
WITH r0 AS (SELECT row_number() OVER () AS i, '' AS path, w * (p - y) AS g, w * p * (1 - p) AS h, l_quantity AS v0, l_discount AS v1, CASE WHEN l_partkey % 9 <> 0 THEN l_tax END AS v2
  FROM (SELECT *, (l_returnflag = 'N')::INTEGER AS y, CASE WHEN l_returnflag = 'N' THEN {second} ELSE 1.0 END::DOUBLE AS w, {p} AS p FROM lineitem)),"""]
    columns = "unnest([0, 1, 2]) AS j, unnest([v0, v1, v2]) AS v"
    for k in range(steps):
        sql.append(f"""
t{k} AS (SELECT path, sum(g) AS tg, sum(h) AS th, count(*) AS tn FROM r{k} {"WHERE length(path) = " + str(k) if kind != "leaf" else ""} GROUP BY path),
e{k} AS (SELECT j, v FROM (SELECT DISTINCT {columns} FROM r0) WHERE v IS NOT NULL),
s{k} AS (SELECT path, j, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (SELECT path, g, h, {columns} FROM r{k}) GROUP BY ALL),
c{k} AS (SELECT t{k}.*, e.j, e.v, sum(coalesce(s.g, 0)) OVER w AS lg, sum(coalesce(s.h, 0)) OVER w AS lh, sum(coalesce(s.n, 0)) OVER w AS ln,
  coalesce(m.g, 0) AS mg, coalesce(m.h, 0) AS mh, coalesce(m.n, 0) AS mn
  FROM t{k} JOIN e{k} e ON true LEFT JOIN s{k} s ON s.path = t{k}.path AND s.j = e.j AND s.v = e.v LEFT JOIN s{k} m ON m.path = t{k}.path AND m.j = e.j AND m.v IS NULL
  WINDOW w AS (PARTITION BY t{k}.path, e.j ORDER BY e.v)),
d{k} AS (SELECT path, j, v, tg, th, tn, 0 AS ml, lg, lh, ln FROM c{k} UNION ALL SELECT path, j, v, tg, th, tn, 1, lg + mg, lh + mh, ln + mn FROM c{k}),
g{k} AS (SELECT *, {worth("lg", "lh")} + {worth("(tg - lg)", "(th - lh)")} - {worth("tg", "th")} AS gain FROM d{k}
  WHERE ln >= {max(min_rows, 1)} AND tn - ln >= {max(min_rows, 1)} AND lh >= {min_hessian} AND th - lh >= {min_hessian}),""")
        if kind == "symmetric":
            sql.append(f"""
b{k} AS (SELECT j, v, ml, sum(gain) AS gain FROM g{k} GROUP BY j, v, ml ORDER BY gain DESC, ml, j, v LIMIT 1),
x{k} AS (SELECT t.path, b.j, b.v, b.ml, b.gain FROM t{k} t, b{k} b WHERE b.gain > 1e-6),""")
        else:
            pick = "QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, ml, j, v) = 1" if kind == "level" else "ORDER BY gain DESC, length(path), path, ml, j, v LIMIT 1"
            sql.append(f"""
x{k} AS (SELECT path, j, v, ml, gain FROM g{k} WHERE gain > 1e-6 AND gain >= {gamma} {pick}),""")
        value = "CASE x.j WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END"
        sql.append(f"""
r{k + 1} AS (SELECT i, CASE WHEN x.path IS NULL THEN r.path WHEN CASE WHEN {value} IS NULL THEN x.ml = 1 ELSE {value} <= x.v END THEN r.path || 'L' ELSE r.path || 'R' END AS path, g, h, v0, v1, v2
  FROM r{k} r LEFT JOIN x{k} x ON x.path = r.path){"," if k + 1 < steps else ""}""")
    inner = " UNION ALL ".join(f"SELECT path, j, v, gain FROM x{k}" for k in range(steps))
    sql.append(f""",
inner_nodes AS ({inner}),
all_nodes AS (SELECT path FROM inner_nodes UNION SELECT path || 'L' FROM inner_nodes UNION SELECT path || 'R' FROM inner_nodes),
sums AS (SELECT n.path, count(i) AS n_rows, coalesce(sum(g), 0) AS grad, coalesce(sum(h), 0) AS hess FROM all_nodes n LEFT JOIN r{steps} r ON starts_with(r.path, n.path) GROUP BY n.path)
SELECT s.path, ['l_quantity', 'l_discount', 'l_tax'][j + 1] AS feature, v::DOUBLE AS cut, round(gain, 4) AS gain, n_rows, round(grad, 4) AS grad, round(hess, 4) AS hess,
  CASE WHEN j IS NULL THEN round(-{rate} * sign(grad) * greatest(abs(grad) - {l1}, 0) / (hess + {l2}), 4) + 0.0 END AS value
FROM sums s LEFT JOIN inner_nodes x ON x.path = s.path WHERE n_rows > 0""")
    return "".join(sql)


@query("m4_boosted_nodes", replay("level", 3, 2.0, 1.0, 2.0, 0.5, 5.0, 1, 0.1))
def m4_nodes(spark, sf):
    return _first_tree(spark, _fitted(spark, sf, boosting.BoostSpec(1, 0.1, "level", 3, 0, 1.0, 2.0, 0.5, 5.0, 1), 2.0))


@query("m5_leafwise_nodes", replay("leaf", 5, 4.0, 0.5, 1.0, 0.0, 0.001, 20, 0.1))
def m5_nodes(spark, sf):
    return _first_tree(spark, _fitted(spark, sf, boosting.BoostSpec(1, 0.1, "leaf", 0, 6, 0.5, 1.0, 0.0, 1e-3, 20), 4.0))


@query("m6_symmetric_nodes", replay("symmetric", 3, 2.0, 0.0, 3.0, 0.0, 0.0, 1, 0.1))
def m6_nodes(spark, sf):
    return _first_tree(spark, _fitted(spark, sf, boosting.BoostSpec(1, 0.1, "symmetric", 3, 0, 0.0, 3.0, min_hessian=0.0), 2.0))


@query("m6_ordered_statistics", with_(ORDERS) + """
SELECT row_id, round((coalesce(sum(label) OVER w, 0) + 0.5) / (count(*) OVER w + 1), 6) AS stat FROM ord
WINDOW w AS (PARTITION BY prio ORDER BY md5('42:' || row_id::VARCHAR), row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def m6_statistics(spark, sf):
    o = orders(spark, sf).select("row_id", "prio", (F.col("status") == "F").cast("int").alias("label"))
    return round_all(ordered_target_statistics(o, "prio", "label", "row_id", prior=0.5, seed=42, name="stat").select("row_id", "stat"))
