"""The driver's tables as items, so that every search runs on them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    x, y = (n * 7 % 340 - 170).cast("double"), (n * 13 % 160 - 80).cast("double")
    extended = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "m": '), (n % 11).cast("string"), F.lit("}"))
    return e.select(
        n.alias("event_id"), n.cast("string").alias("id"), F.col("event_type").alias("collection"), F.col("ts").alias("datetime"),
        (F.col("ts") + F.make_dt_interval(hours=(n % 48).cast("int"))).alias("end_datetime"),
        x.alias("xmin"), y.alias("ymin"), (x + 5).alias("xmax"), (y + 5).alias("ymax"),
        F.when(n % 3 == 0, extended).otherwise(F.col("props")).alias("properties"), "value", "user_id",
    )


EVENTS = """items AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS id, event_type AS collection, ts AS datetime, ts + to_hours(CAST(event_id % 48 AS INTEGER)) AS end_datetime,
         CAST(event_id * 7 % 340 - 170 AS DOUBLE) AS xmin, CAST(event_id * 13 % 160 - 80 AS DOUBLE) AS ymin, CAST(event_id * 7 % 340 - 165 AS DOUBLE) AS xmax, CAST(event_id * 13 % 160 - 75 AS DOUBLE) AS ymax,
         CASE WHEN event_id % 3 = 0 THEN left(props, length(props) - 1) || ', "m": ' || CAST(event_id % 11 AS VARCHAR) || '}' ELSE props END AS properties, value, user_id
  FROM events)"""


def orders_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    x, y = (k * 11 % 350 - 175).cast("double"), (k * 17 % 170 - 85).cast("double")
    return o.select(
        k.alias("o_orderkey"), k.cast("string").alias("id"), F.col("o_orderstatus").alias("collection"), F.col("o_orderdate").alias("datetime"),
        (F.col("o_orderdate") + F.make_dt_interval(days=(k % 90).cast("int"))).alias("end_datetime"),
        x.alias("xmin"), y.alias("ymin"), (x + 2).alias("xmax"), (y + 2).alias("ymax"), F.to_json(F.struct("o_orderpriority", "o_custkey")).alias("properties"), "o_totalprice", "o_orderpriority",
        F.date_format("o_orderdate", "yyyyMM").alias("dt_bucket"),
    )


ORDERS = """items AS (
  SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS collection, o_orderdate AS datetime, o_orderdate + to_days(CAST(o_orderkey % 90 AS INTEGER)) AS end_datetime,
         CAST(o_orderkey * 11 % 350 - 175 AS DOUBLE) AS xmin, CAST(o_orderkey * 17 % 170 - 85 AS DOUBLE) AS ymin, CAST(o_orderkey * 11 % 350 - 173 AS DOUBLE) AS xmax, CAST(o_orderkey * 17 % 170 - 83 AS DOUBLE) AS ymax,
         o_totalprice, o_orderpriority, o_custkey, strftime(o_orderdate, '%Y%m') AS dt_bucket
  FROM orders)"""


def parts_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    at = F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00"))
    return p.select(
        F.col("p_partkey").alias("p_partkey"), F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("collection"), at.alias("datetime"), at.alias("end_datetime"),
        "p_name", "p_brand", "p_type", "p_size", "p_retailprice", F.split("p_name", " ").alias("words"),
        F.to_json(F.struct(F.split("p_name", " ").alias("tags"), F.col("p_size").alias("size"))).alias("properties"),
    )


PARTS = "items AS (SELECT *, string_split(p_name, ' ') AS words FROM part)"


def documents_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00"))
    return d.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("collection"), at.alias("datetime"), at.alias("end_datetime"), F.col("text").alias("description"), F.lit("").alias("title"), F.lit("").alias("keywords"), F.lit("{}").alias("properties"), "lang")
