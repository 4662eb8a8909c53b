"""Transaction-shaped views over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    dt = (F.unix_seconds(F.col("ts").cast("timestamp")) - EPOCH).cast("bigint")
    base = e.select("event_id", "user_id", "event_type", "value", k.alias("k"), dt.alias("dt"))
    first = F.min("dt").over(Window.partitionBy("user_id"))
    i, u = F.col("event_id"), F.col("user_id")
    return base.withColumn("first", first).select(
        i.alias("TransactionID"), F.col("dt").alias("TransactionDT"), F.expr("dt div 3600").alias("hour"), F.col("value").alias("TransactionAmt"),
        ((F.col("value") > 100) & (F.col("k") % 3 == 0)).cast("int").alias("isFraud"), F.col("event_type").alias("ProductCD"), "k",
        u.cast("double").alias("card1"), F.when(i % 7 != 0, u % 50).cast("double").alias("card2"), F.lit(150.0).alias("card3"), (200 + u % 5).cast("double").alias("card5"),
        F.when(F.col("k") % 10 != 0, F.col("k")).cast("double").alias("addr1"), (80 + F.col("k") % 3).cast("double").alias("addr2"),
        F.when(i % 11 != 0, F.expr("(dt - first) div 86400")).cast("double").alias("D1"), u.alias("user_id"),
    )


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 4 = 0")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("TransactionID"), F.concat(F.lit("SM-G"), (F.col("user_id") % 37).cast("string"), F.lit(" Build/NRD"), (k % 5).cast("string")).alias("DeviceInfo"),
        F.concat(F.lit("Chrome "), (k % 7).cast("string"), F.lit(".0")).alias("id_31"),
    )


def order_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of all orders: an order and its customer, its date and priority, its price cell."""
    o = table(spark, sf_dir, "orders")
    cell = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("txn"), F.col("o_custkey").cast("string").alias("customer"), cell.alias("cell"), F.floor(F.col("o_totalprice") / 10).cast("bigint").cast("string").alias("price"))


TX_SQL = """
e AS (SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, epoch_us(ts) // 1000000 - 1704067200 AS dt FROM events),
tx AS (SELECT event_id AS TransactionID, dt AS TransactionDT, dt // 3600 AS hour, value AS TransactionAmt, CAST(value > 100 AND k % 3 = 0 AS INTEGER) AS isFraud, event_type AS ProductCD, k,
  CAST(user_id AS DOUBLE) AS card1, CAST(CASE WHEN event_id % 7 <> 0 THEN user_id % 50 END AS DOUBLE) AS card2, CAST(150 AS DOUBLE) AS card3, CAST(200 + user_id % 5 AS DOUBLE) AS card5,
  CAST(CASE WHEN k % 10 <> 0 THEN k END AS DOUBLE) AS addr1, CAST(80 + k % 3 AS DOUBLE) AS addr2,
  CAST(CASE WHEN event_id % 11 <> 0 THEN (dt - min(dt) OVER (PARTITION BY user_id)) // 86400 END AS DOUBLE) AS D1, user_id FROM e),
ident AS (SELECT event_id AS TransactionID, 'SM-G' || (user_id % 37) || ' Build/NRD' || (k % 5) AS DeviceInfo, 'Chrome ' || (k % 7) || '.0' AS id_31 FROM e WHERE event_id % 4 = 0)
"""
ORDERS_SQL = """
o AS (SELECT o_orderkey AS txn, CAST(o_custkey AS VARCHAR) AS customer, strftime(o_orderdate, '%Y-%m-%d') || '/' || o_orderpriority AS cell,
  CAST(CAST(floor(o_totalprice / 10) AS BIGINT) AS VARCHAR) AS price FROM orders)
"""
