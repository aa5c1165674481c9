"""Column names, types, dates, categories and raw-row alignment."""

from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import encode, profile, schema
from ..plans.bundle import RawPreprocessor, decode_label
from .bases import CUSTOMERS, EVENTS, ORDERS, customers, events, nulled, orders, query, round_all, table, with_

NAMES = """
nm AS (SELECT p_partkey AS pos, p_type AS grp, '__' || p_name || ' ' || p_brand || '-' || p_size || '_' AS name FROM part)
"""


def _names(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_type").alias("grp"),
        F.concat(F.lit("__"), "p_name", F.lit(" "), "p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit("_")).alias("name"))


@query("p1_sanitize_names", with_(NAMES) + """
, b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\d+', '', 'g'), '[^\\w]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS base FROM nm),
n AS (SELECT *, row_number() OVER (PARTITION BY grp, base ORDER BY pos) - 1 AS k FROM b)
SELECT pos, CASE WHEN k > 0 THEN base || '_' || k ELSE base END AS clean_name FROM n""")
def p1(spark, sf):
    return schema.sanitize_catalog(_names(spark, sf), "name", "pos", by=["grp"]).select("pos", "clean_name")


@query("p2_sanitize_simple", with_(NAMES) + "SELECT pos, regexp_replace(name, '[^\\w]', '_', 'g') AS clean_name FROM nm")
def p2(spark, sf):
    return schema.sanitize_catalog(_names(spark, sf), "name", "pos", mode="simple").select("pos", "clean_name")


@query("p3_drop_missing_target", with_(ORDERS) + "SELECT row_id, price, status FROM ord WHERE price IS NOT NULL")
def p3(spark, sf):
    return schema.drop_missing_target(orders(spark, sf), "price").select("row_id", "price", "status")


@query("p4_missing_shares", with_(ORDERS) + """
SELECT 'price' AS "column", round(avg((price IS NULL)::INT), 6) AS missing_share FROM ord UNION ALL
SELECT 'cust', round(avg((cust IS NULL)::INT), 6) FROM ord UNION ALL SELECT 'prio', round(avg((prio IS NULL)::INT), 6) FROM ord""")
def p4a(spark, sf):
    return round_all(schema.missing_shares(orders(spark, sf), ["price", "cust", "prio"]))


@query("p4_drop_sparse_columns", with_(ORDERS) + "SELECT row_id, cust, prio FROM ord")
def p4b(spark, sf):
    return schema.drop_sparse_columns(orders(spark, sf).select("row_id", "price", "cust", "prio"), 0.10)


@query("p5_drop_rows", with_(CUSTOMERS) + "SELECT * FROM cust WHERE bal IS NOT NULL AND nat IS NOT NULL")
def p5(spark, sf):
    return schema.drop_rows_with_missing(customers(spark, sf))


@query("p6_split_target", with_(ORDERS) + "SELECT row_id, price, cust FROM ord")
def p6(spark, sf):
    return orders(spark, sf).select("row_id", "price", "cust", "status").drop("status")


@query("p7_align_features", with_(CUSTOMERS) + "SELECT row_id, nat::FLOAT AS nat, NULL::FLOAT AS ghost, round(bal, 2)::FLOAT AS bal FROM cust")
def p7(spark, sf):
    return schema.align_features(customers(spark, sf), ["nat", "ghost", "bal"], keep=["row_id"])


@query("p8_numeric_columns", """
SELECT c AS "column", k AS kind FROM (
  SELECT 'c_custkey' AS c, CASE WHEN count(DISTINCT c_custkey) > 10 THEN 'wide' ELSE 'narrow' END AS k FROM customer UNION ALL
  SELECT 'c_nationkey', CASE WHEN count(DISTINCT c_nationkey) > 10 THEN 'wide' ELSE 'narrow' END FROM customer UNION ALL
  SELECT 'c_acctbal', CASE WHEN count(DISTINCT c_acctbal) > 10 THEN 'wide' ELSE 'narrow' END FROM customer UNION ALL
  SELECT 'c_flag', CASE WHEN count(DISTINCT c_nationkey % 2) > 10 THEN 'wide' ELSE 'narrow' END FROM customer UNION ALL
  SELECT 'c_name', 'categorical' UNION ALL SELECT 'c_mktsegment', 'categorical')""")
def p8(spark, sf):
    df = table(spark, sf, "customer").withColumn("c_flag", F.col("c_nationkey") % 2)
    numeric = schema.numeric_columns(df)
    wide = set(schema.columns_with_many_values(df, numeric, 10))
    rows = [(c, "wide" if c in wide else "narrow") for c in numeric] + [(c, "categorical") for c in schema.categorical_columns(df)]
    return spark.createDataFrame(rows, "column string, kind string")


def _date_texts(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderkey") % 6 != 0, F.date_format(d, "yyyy-MM-dd")).alias("iso"),
        F.concat_ws("/", (F.year(d) - 621).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")).alias("jalali"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyy/MM/dd")).otherwise("not a date").alias("mixed"),
        F.col("o_orderpriority").alias("prio"), F.lit(None).cast("string").alias("empty"))


DATE_TEXTS = """
dt AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 6 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso,
  (year(o_orderdate) - 621) || '/' || month(o_orderdate) || '/' || day(o_orderdate) AS jalali,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE 'not a date' END AS mixed,
  o_orderpriority AS prio, NULL::VARCHAR AS empty, o_orderdate FROM orders)
"""


@query("p9_date_columns", with_(DATE_TEXTS) + """
SELECT c AS "column", cal AS calendar FROM (
  SELECT 'iso' AS c, 'gregorian' AS cal, bool_and(try_strptime(iso, '%Y-%m-%d') IS NOT NULL OR iso IS NULL) AND count(iso) > 0 AS ok FROM dt UNION ALL
  SELECT 'mixed', 'gregorian', bool_and(try_strptime(mixed, '%Y/%m/%d') IS NOT NULL) FROM dt UNION ALL
  SELECT 'jalali', 'jalali', bool_and(split_part(jalali, '/', 1)::INT BETWEEN 1200 AND 1500 AND
     (split_part(jalali, '/', 2)::INT <= 6 OR split_part(jalali, '/', 3)::INT <= 30)) FROM dt) WHERE ok""")
def p9(spark, sf):
    df = _date_texts(spark, sf)
    # Day 31 does not exist in the second half of a Jalali year, so such a column is no Jalali date column.
    found = schema.date_columns(df, ["iso", "jalali", "mixed", "prio", "empty"])
    return spark.createDataFrame(list(found.items()), "column string, calendar string")


@query("p10_pure_date_text", with_(DATE_TEXTS) + """
SELECT row_id, regexp_full_match(iso, '\\d+-\\d+-\\d+') IS TRUE AS iso, regexp_full_match(jalali, '\\d+/\\d+/\\d+') AS jalali,
  regexp_full_match(mixed, '\\d+/\\d+/\\d+') AS mixed, false AS prio FROM dt""")
def p10(spark, sf):
    return _date_texts(spark, sf).select("row_id", *[dates.is_pure_date_string(F.col(c)).alias(c) for c in ("iso", "jalali", "mixed", "prio")])


@query("p11_value_patterns", with_(DATE_TEXTS) + """
, l AS (SELECT row_id, 'iso' AS name, iso AS v FROM dt UNION ALL SELECT row_id, 'prio', prio FROM dt UNION ALL
  SELECT row_id, 'bit', (row_id % 2)::VARCHAR FROM dt UNION ALL SELECT row_id, 'mixed', mixed FROM dt),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY row_id) AS k FROM l WHERE v IS NOT NULL) WHERE k <= 20)
SELECT name, concat_ws(',', CASE WHEN bool_and(regexp_full_match(v, '[01]')) THEN 'binary_numeric' END,
  CASE WHEN bool_and(regexp_full_match(v, '\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}')) THEN 'date_like' END) AS patterns FROM h GROUP BY name""")
def p11(spark, sf):
    df = _date_texts(spark, sf).withColumn("bit", (F.col("row_id") % 2).cast("string"))
    first = profile.first_values(df, ["iso", "prio", "bit", "mixed"], "row_id", 20)
    return first.select(F.col("column").alias("name"), F.array_join(profile.value_patterns(F.col("samples")), ",").alias("patterns"))


@query("o6_first_values", """
WITH l AS (SELECT event_id, 'event_type' AS c, event_type AS v FROM events UNION ALL SELECT event_id, 'user_id', user_id::VARCHAR FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY event_id) AS k FROM l)
SELECT c AS "column", string_agg(v, '|' ORDER BY k) AS samples FROM r WHERE k <= 20 GROUP BY c""")
def o6(spark, sf):
    found = profile.first_values(table(spark, sf, "events"), ["event_type", "user_id"], "event_id", 20)
    return found.select("column", F.array_join("samples", "|").alias("samples"))


# ---- dates --------------------------------------------------------------------------------------


@query("f5_calendar_parts", """
SELECT event_id, year(ts)::DOUBLE AS ts_year, month(ts)::DOUBLE AS ts_month, day(ts)::DOUBLE AS ts_day, (isodow(ts) - 1)::DOUBLE AS ts_day_of_week,
  hour(ts)::DOUBLE AS ts_hour, dayofyear(ts)::DOUBLE AS ts_day_of_year, (isodow(ts) >= 6)::INT::DOUBLE AS ts_is_weekend FROM events""")
def f5(spark, sf):
    return table(spark, sf, "events").select("event_id", *dates.calendar_parts(F.col("ts"), "ts"))


@query("f6_calendar_type", with_(DATE_TEXTS) + """
SELECT row_id, CASE WHEN iso IS NULL THEN 'unknown' ELSE 'gregorian' END AS iso, 'jalali' AS jalali,
  CASE WHEN mixed LIKE '%/%' THEN 'gregorian' ELSE 'unknown' END AS mixed FROM dt""")
def f6(spark, sf):
    return _date_texts(spark, sf).select("row_id", *[dates.calendar_type(F.col(c)).alias(c) for c in ("iso", "jalali", "mixed")])


# The check builds the calendar day by day instead of using a closed form.
JALALI_DAYS = """
RECURSIVE yr(y, start) AS (SELECT 1370, DATE '1991-03-21' UNION ALL
  SELECT y + 1, start + (CASE WHEN y % 33 IN (1, 5, 9, 13, 17, 22, 26, 30) THEN 366 ELSE 365 END) FROM yr WHERE y < 1400),
cal AS (SELECT y, m, d, start + (CASE WHEN m <= 6 THEN (m - 1) * 31 ELSE 186 + (m - 7) * 30 END + d - 1)::INT AS g
  FROM yr, range(1, 13) AS a(m), range(1, 32) AS b(d)
  WHERE d <= CASE WHEN m <= 6 THEN 31 WHEN m <= 11 THEN 30 WHEN y % 33 IN (1, 5, 9, 13, 17, 22, 26, 30) THEN 30 ELSE 29 END)
"""


@query("f7_jalali_to_gregorian", "WITH " + JALALI_DAYS + """
SELECT o_orderkey AS row_id, g::DATE AS gregorian FROM orders
LEFT JOIN cal ON y = year(o_orderdate) - 621 AND m = month(o_orderdate) AND d = day(o_orderdate)""")
def f7(spark, sf):
    return _date_texts(spark, sf).select("row_id", dates.parse_jalali(F.col("jalali")).cast("date").alias("gregorian"))


@query("f8_tolerant_parse", with_(DATE_TEXTS) + """
SELECT row_id, try_strptime(iso, '%Y-%m-%d')::DATE AS iso, try_strptime(mixed, '%Y/%m/%d')::DATE AS mixed FROM dt""")
def f8(spark, sf):
    return _date_texts(spark, sf).select("row_id", *[dates.parse_gregorian(F.col(c)).cast("date").alias(c) for c in ("iso", "mixed")])


@query("f9_days_between", """
SELECT event_id, round((epoch_us(TIMESTAMP '2024-06-01') - epoch_us(ts)) / 86400000000.0, 6) AS days FROM events""")
def f9(spark, sf):
    return round_all(table(spark, sf, "events").select("event_id", dates.days_between(F.to_timestamp(F.lit("2024-06-01")), F.col("ts")).alias("days")))


@query("t2_expand_dates", with_(DATE_TEXTS) + """
SELECT row_id, prio, year(i)::DOUBLE AS iso_year, month(i)::DOUBLE AS iso_month, day(i)::DOUBLE AS iso_day, (isodow(i) - 1)::DOUBLE AS iso_day_of_week,
  hour(i)::DOUBLE AS iso_hour, dayofyear(i)::DOUBLE AS iso_day_of_year, coalesce((isodow(i) >= 6)::INT, 0)::DOUBLE AS iso_is_weekend,
  CASE WHEN i IS NOT NULL THEN 0.0::DOUBLE END AS iso_time_diff
FROM (SELECT *, try_strptime(iso, '%Y-%m-%d') AS i FROM dt)""")
def t2(spark, sf):
    df = _date_texts(spark, sf).select("row_id", "prio", "iso")
    return encode.expand_dates(df, schema.date_columns(df, ["iso", "prio"]), reference="iso")


# ---- categories ---------------------------------------------------------------------------------

NATION_MAP = """
mp AS (SELECT category, row_number() OVER (ORDER BY f) - 1 AS code FROM (
  SELECT s_nationkey::VARCHAR AS category, min(s_suppkey) AS f FROM supplier GROUP BY 1))
"""


def _nation_map(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"))
    return encode.category_map(s, ["nation"], "s_suppkey")


@query("a13_first_seen_codes", """
WITH l AS (SELECT o_orderkey AS k, 'prio' AS c, o_orderpriority AS v FROM orders UNION ALL SELECT o_orderkey, 'cust', o_custkey::VARCHAR FROM orders),
f AS (SELECT c, v, min(k) AS k FROM l GROUP BY c, v)
SELECT c AS "column", v AS category, (row_number() OVER (PARTITION BY c ORDER BY k) - 1)::INTEGER AS code FROM f""")
def a13(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("prio"), F.col("o_custkey").alias("cust"))
    return encode.category_map(df, ["prio", "cust"], "o_orderkey")


@query("j1_category_lookup", with_(NATION_MAP) + "SELECT c_custkey, code::DOUBLE AS nation FROM customer LEFT JOIN mp ON category = c_nationkey::VARCHAR")
def j1(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return encode.encode_categories(df, _nation_map(spark, sf), ["nation"], "null")


@query("j2_category_lookup_keep", with_(NATION_MAP) + "SELECT c_custkey, coalesce(code, c_nationkey)::DOUBLE AS nation FROM customer LEFT JOIN mp ON category = c_nationkey::VARCHAR")
def j2(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return encode.encode_categories(df, _nation_map(spark, sf), ["nation"], "keep", literal_rows=0)


@query("j4_join_by_row", with_(CUSTOMERS) + "SELECT a.row_id, a.bal, b.label FROM cust a JOIN cust b USING (row_id)")
def j4(spark, sf):
    c = customers(spark, sf)
    return c.select("row_id", "bal").join(c.select("row_id", "label"), "row_id")


@query("t1_to_numeric", """
WITH p AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1),
s AS (SELECT o_orderstatus AS v, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1)
SELECT o_orderkey AS row_id, p.code::DOUBLE AS prio, s.code::DOUBLE AS status, year(o_orderdate)::DOUBLE AS odate_year, month(o_orderdate)::DOUBLE AS odate_month,
  day(o_orderdate)::DOUBLE AS odate_day, (isodow(o_orderdate) - 1)::DOUBLE AS odate_day_of_week, 0.0::DOUBLE AS odate_hour,
  dayofyear(o_orderdate)::DOUBLE AS odate_day_of_year, (isodow(o_orderdate) >= 6)::INT::DOUBLE AS odate_is_weekend
FROM orders JOIN p ON p.v = o_orderpriority JOIN s ON s.v = o_orderstatus""")
def t1(spark, sf):
    df = orders(spark, sf).select("row_id", "prio", "status", F.date_format("odate", "yyyy-MM-dd").alias("odate"))
    return encode.to_numeric(df, "status", "row_id")[0]


@query("t3_label_codes", "SELECT o_orderkey AS row_id, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS label FROM orders")
def t3(spark, sf):
    df = orders(spark, sf).select("row_id", "status")
    return encode.encode_label(df, encode.label_codes(df, "status"), "status").select("row_id", "label")


@query("t4_raw_preprocess", """
WITH mp AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1)
SELECT o_orderkey AS row_id, (CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END)::FLOAT AS price_, code::FLOAT AS prio,
  year(o_orderdate)::FLOAT AS odate_year, NULL::FLOAT AS ghost FROM orders JOIN mp ON v = o_orderpriority""")
def t4(spark, sf):
    df = orders(spark, sf).select("row_id", F.col("price").alias("price$"), "prio", F.date_format("odate", "yyyy-MM-dd").alias("odate"), "status")
    mapping = encode.category_map(df, ["prio"], "row_id")
    pre = RawPreprocessor("status", {"odate": "gregorian"}, mapping, ["price_", "prio", "odate_year", "ghost"], "simple")
    return pre.transform(df, keep=("row_id",))


# ---- scalar expressions -------------------------------------------------------------------------


@query("f2_compact_name", with_(NAMES) + """
SELECT pos, replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(name)), '[_\\-./\\\\]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g')), '\\s+', ' ', 'g'), ' ', '') AS with_number,
  replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(name)), '[_\\-./\\\\]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g')), '\\s+', ' ', 'g'), '\\s+[0-9]+$', ''), ' ', '') AS compact FROM nm""")
def f2(spark, sf):
    n = F.col("name")
    plain = F.concat(n, F.lit(" x"))
    return _names(spark, sf).select(
        "pos", F.regexp_replace(text.compact_normalize(plain), "x$", "").alias("with_number"), text.compact_normalize(n).alias("compact"))


@query("f1_normalize_text", with_(NAMES) + """
SELECT pos, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[_\\-./\\\\]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+[0-9]+$', '') AS norm FROM nm""")
def f1(spark, sf):
    return _names(spark, sf).select("pos", text.normalize_text(F.col("name")).alias("norm"))


@query("f1_normalize_unicode")
def f1u(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text"), unicode=True).alias("norm"))


@query("f3_clean_text", """
SELECT page_id, nullif(trim(regexp_replace(url, '[:/?&=.]+', ' ', 'g')), '') AS cleaned, lower(trim(regexp_replace(url, '\\s+', ' ', 'g'))) AS dedup FROM pages""")
def f3(spark, sf):
    spaced = F.regexp_replace("url", "[:/?&=.]", "  ")
    return table(spark, sf, "pages").select("page_id", text.clean_string(spaced).alias("cleaned"), text.dedup_key(F.col("url")).alias("dedup"))


@query("f10_unit_scale", """
SELECT o_orderkey AS row_id, round((o_totalprice - lo) / (hi - lo), 6) AS unit, 0.0::DOUBLE AS constant
FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""")
def f10(spark, sf):
    df = table(spark, sf, "orders")
    row = df.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    return round_all(df.select(F.col("o_orderkey").alias("row_id"), numbers.unit_scale(F.col("o_totalprice"), row[0], row[1]).alias("unit"),
                               numbers.unit_scale(F.lit(7.0), 7.0, 7.0).alias("constant")))


@query("f11_clip_and_maps", with_(ORDERS) + """
SELECT row_id, CASE WHEN price IS NULL THEN NULL ELSE greatest(least(price, 400000.0), 100000.0) END AS clipped,
  round(2.0 + (row_id % 100) / 100.0 * 3.0, 6) AS lin, round(exp(ln(0.01) + (row_id % 100) / 100.0 * (ln(0.3) - ln(0.01))), 6) AS logged FROM ord""")
def f11(spark, sf):
    u = (F.col("row_id") % 100) / 100.0
    return round_all(orders(spark, sf).select(
        "row_id", numbers.clip(F.col("price"), 100000.0, 400000.0).alias("clipped"), numbers.lerp(u, F.lit(2.0), F.lit(5.0)).alias("lin"),
        numbers.log_lerp(u, F.lit(0.01), F.lit(0.3)).alias("logged")))


@query("f12_p_value_text", with_(ORDERS) + """
SELECT row_id, CASE WHEN p > 0.0001 THEN printf('%.6f', p) ELSE printf('%.2e', p) END AS formatted,
  CASE WHEN p <= 0.05 THEN 'Significant' ELSE 'Not Significant' END AS significance FROM (SELECT row_id, exp(-(row_id % 40) / 2.0) AS p FROM ord)""")
def f12(spark, sf):
    df = orders(spark, sf).select("row_id", F.exp(-(F.col("row_id") % 40) / 2.0).alias("p"))
    return df.select("row_id", numbers.format_p_value(F.col("p")).alias("formatted"), numbers.significance(F.col("p")).alias("significance"))


@query("f13_unit_vectors", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm,
  round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings""")
def f13(spark, sf):
    v = F.col("embedding")
    return round_all(table(spark, sf, "embeddings").select(
        "vec_id", F.sqrt(numbers.dot(v, v)).alias("norm"), F.get(numbers.l2_normalize(v), F.lit(0)).alias("first")), 5)


@query("f15_invert_map", """
SELECT p_partkey, p_size AS code, p_name AS name FROM part""")
def f15(spark, sf):
    forward = F.create_map(F.col("p_name"), F.col("p_size"))
    back = numbers.invert_map(forward)
    return table(spark, sf, "part").select("p_partkey", F.map_keys(back)[0].alias("code"), F.map_values(back)[0].alias("name"))


@query("f16_decode_label", """
SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'healthy' WHEN 1 THEN 'sick' ELSE '2' END AS label FROM events""")
def f16(spark, sf):
    return table(spark, sf, "events").select("event_id", decode_label((F.col("user_id") % 3).cast("int"), {0: "healthy", 1: "sick"}).alias("label"))


def first_slice(spark, sf):
    """Clean, impute, tame and scale orders joined to customers; the flagship flow."""
    from ..operators import impute, scale
    from ..operators.outlier import OutlierTamer

    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", nulled("o_totalprice", "o_orderkey", 7).alias("o_totalprice"),
                                          F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority", "o_orderstatus")
    c = table(spark, sf, "customer").select("c_custkey", nulled("c_acctbal", "c_custkey", 5).alias("c_acctbal"), "c_mktsegment")
    raw = o.join(c, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    raw = raw.withColumn("label", (F.col("o_orderstatus") == "F").cast("int")).drop("o_orderstatus")
    expanded = encode.expand_dates(raw, {"o_orderdate": "gregorian"})
    mapping = encode.category_map(expanded, ["o_orderpriority", "c_mktsegment"], "o_orderkey")
    coded = encode.encode_categories(expanded, mapping, ["o_orderpriority", "c_mktsegment"], "keep")
    cols = ["o_totalprice", "c_acctbal"]
    filled = impute.fit_mean(coded, cols).transform(coded)
    tamer = OutlierTamer("statistical", "winsorize", mad_threshold=1.0, row_id="o_orderkey").fit(filled, cols)
    tamed = tamer.transform(filled)
    return scale.fit_zscore(tamed, cols).transform(tamed)


@query("t0_prepare_orders", """
WITH raw AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS b,
  o_orderpriority, c_mktsegment, o_orderdate AS d, (o_orderstatus = 'F')::INT AS label FROM orders JOIN customer ON o_custkey = c_custkey),
pm AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM raw GROUP BY 1),
sm AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM raw GROUP BY 1),
f AS (SELECT * REPLACE (coalesce(p, (SELECT avg(p) FROM raw)) AS p, coalesce(b, (SELECT avg(b) FROM raw)) AS b) FROM raw),
m AS (SELECT median(p) AS mp, median(b) AS mb, quantile_cont(p, 0.01) AS lp, quantile_cont(p, 0.99) AS hp, quantile_cont(b, 0.01) AS lb, quantile_cont(b, 0.99) AS hb FROM f),
k AS (SELECT median(abs(p - mp)) * 1.4826 AS kp, median(abs(b - mb)) * 1.4826 AS kb FROM f, m),
w AS (SELECT f.* REPLACE (CASE WHEN abs((p - mp) / kp) > 1 AND p < lp THEN lp WHEN abs((p - mp) / kp) > 1 AND p > hp THEN hp ELSE p END AS p,
  CASE WHEN abs((b - mb) / kb) > 1 AND b < lb THEN lb WHEN abs((b - mb) / kb) > 1 AND b > hb THEN hb ELSE b END AS b) FROM f, m, k)
SELECT o_orderkey, label, pm.code::DOUBLE AS o_orderpriority, sm.code::DOUBLE AS c_mktsegment,
  round((p - (SELECT avg(p) FROM w)) / (SELECT stddev_pop(p) FROM w), 5) AS o_totalprice, round((b - (SELECT avg(b) FROM w)) / (SELECT stddev_pop(b) FROM w), 5) AS c_acctbal,
  year(d)::DOUBLE AS o_orderdate_year, month(d)::DOUBLE AS o_orderdate_month, day(d)::DOUBLE AS o_orderdate_day, (isodow(d) - 1)::DOUBLE AS o_orderdate_day_of_week,
  0.0::DOUBLE AS o_orderdate_hour, dayofyear(d)::DOUBLE AS o_orderdate_day_of_year, (isodow(d) >= 6)::INT::DOUBLE AS o_orderdate_is_weekend
FROM w JOIN pm ON pm.v = o_orderpriority JOIN sm ON sm.v = c_mktsegment""")
def t0(spark, sf):
    return round_all(first_slice(spark, sf), 5)
