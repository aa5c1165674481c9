"""Registry of checked queries and the base tables they share.

Missing values are made by a rule on the key, the same in Spark and in the
check SQL; every base covers its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register a query under ``key``, with its check SQL where one exists."""

    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nulled(col: str, key: str, every: int):
    return F.when(F.col(key) % every != 0, F.col(col).cast("double"))


def customers(spark, sf) -> DataFrame:
    """row_id, bal, nat (both with gaps), seg, label."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), nulled("c_acctbal", "c_custkey", 7).alias("bal"), nulled("c_nationkey", "c_custkey", 5).alias("nat"),
        F.col("c_mktsegment").alias("seg"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"),
    )


CUSTOMERS = """
cust AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal,
  CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey::DOUBLE END AS nat, c_mktsegment AS seg,
  (c_mktsegment = 'BUILDING')::INTEGER AS label FROM customer)
"""


def full_customers(spark, sf) -> DataFrame:
    """row_id, x, y, label without gaps; y repeats often."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), (F.col("c_acctbal") / 1000.0).alias("x"), F.col("c_nationkey").cast("double").alias("y"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"),
    )


FULL_CUSTOMERS = """
cust AS (SELECT c_custkey AS row_id, c_acctbal / 1000.0 AS x, c_nationkey::DOUBLE AS y,
  (c_mktsegment = 'BUILDING')::INTEGER AS label FROM customer)
"""


def orders(spark, sf) -> DataFrame:
    """row_id, price, cust (both with gaps), prio, status, label, odate."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), nulled("o_totalprice", "o_orderkey", 7).alias("price"), nulled("o_custkey", "o_orderkey", 11).alias("cust"),
        F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.col("o_orderdate").alias("odate"),
    )


ORDERS = """
ord AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey::DOUBLE END AS cust, o_orderpriority AS prio, o_orderstatus AS status,
  (o_orderstatus = 'F')::INTEGER AS label, o_orderdate AS odate FROM orders)
"""


def events(spark, sf) -> DataFrame:
    """row_id, user_id, etype, ts, value with gaps."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), "user_id", F.col("event_type").alias("etype"), "ts", nulled("value", "event_id", 4).alias("value"))


EVENTS = """
ev AS (SELECT event_id AS row_id, user_id, event_type AS etype, ts, CASE WHEN event_id % 4 <> 0 THEN value END AS value FROM events)
"""


def lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"), (F.col("l_linestatus") == "F").cast("int").alias("label"))


LINES = """
li AS (SELECT l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_returnflag AS flag,
  (l_linestatus = 'F')::INTEGER AS label FROM lineitem)
"""


def scores(spark, sf) -> DataFrame:
    """candidate, repeat, fold, row_id, label and a score with many ties that favours the label."""
    e = table(spark, sf, "events")
    y = (F.col("event_type") == "purchase").cast("int")
    return e.select(
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("candidate"), (F.col("event_id") % 3).cast("int").alias("repeat"),
        (F.floor(F.col("event_id") / 3) % 5).cast("int").alias("fold"), F.col("event_id").alias("row_id"), y.alias("label"),
        (((F.col("event_id") * 7919) % 700 + y * 300) / 1000.0).alias("score"))


SCORES = """
sc AS (SELECT 'c' || (user_id % 4)::VARCHAR AS candidate, (event_id % 3)::INTEGER AS repeat, ((event_id // 3) % 5)::INTEGER AS fold,
  event_id AS row_id, (event_type = 'purchase')::INTEGER AS label,
  ((event_id * 7919) % 700 + (event_type = 'purchase')::INTEGER * 300) / 1000.0::DOUBLE AS score FROM events)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def round_all(df: DataFrame, places: int = 6) -> DataFrame:
    """Round floating columns so both engines print the same digits; minus zero becomes zero."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
