"""The driver's tables as domain objects; every registered query starts from one of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods
from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as detections: id, s, unit, t, frp, x (0 kept, 1 static, 2 low), night, year, p."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    d = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return d.select(
        F.col("o_orderkey").alias("id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("s"),
        F.col("c_nationkey").alias("unit"),
        F.col("o_orderdate").alias("t"),
        F.col("o_totalprice").alias("frp"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("x"),
        (F.col("o_orderkey") % 2 == 0).alias("night"),
        F.year("o_orderdate").alias("year"),
        periods.period(F.col("o_orderdate")).alias("p"),
    )


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as daily coverage: sat, tile, date, unit, clear, cloud, land, and s (0 to 4)."""
    lines = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    land, open_share = F.col("l_quantity"), 1 - 10 * (F.col("l_discount") + 0.0)
    return lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        F.concat("l_returnflag", "l_linestatus").alias("sat"),
        (F.col("l_partkey") % 5).cast("int").alias("s"),
        F.col("l_linenumber").alias("tile"),
        F.to_date("l_shipdate").alias("date"),
        F.col("s_nationkey").alias("unit"),
        (land * open_share).alias("clear"),
        (land * (1 - open_share) / 2).alias("cloud"),
        land.alias("land"),
        F.year("l_shipdate").alias("year"),
        periods.period(F.col("l_shipdate")).alias("p"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a live feed: id, s (sensor name), t, frp, k, lat, lon."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("s"),
        F.col("ts").alias("t"),
        F.col("value").alias("frp"),
        k.alias("k"),
        (20.6 + (k % 61) * 0.1).alias("lat"),
        (88.0 + (F.col("user_id") % 47) * 0.1).alias("lon"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as units with their region as parent."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"))


#: The same objects for the SQL that the queries must equal.
SQL_DETECTIONS = """det AS (
  SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS s, c_nationkey AS unit, o_orderdate AS t, o_totalprice AS frp,
         CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS x, o_orderkey % 2 = 0 AS night,
         year(o_orderdate)::INT AS year, least(46, (dayofyear(o_orderdate) - 1) // 8 + 1)::INT AS p
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
SQL_COVERAGE = """cov AS (
  SELECT l_returnflag || l_linestatus AS sat, (l_partkey % 5)::INT AS s, l_linenumber AS tile, l_shipdate::DATE AS date, s_nationkey AS unit,
         l_quantity * (1 - 10 * (l_discount + 0.0)) AS clear, l_quantity * (1 - (1 - 10 * (l_discount + 0.0))) / 2 AS cloud, l_quantity AS land,
         year(l_shipdate)::INT AS year, least(46, (dayofyear(l_shipdate) - 1) // 8 + 1)::INT AS p
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
SQL_FEED = """feed AS (
  SELECT event_id AS id, event_type AS s, ts AS t, value AS frp, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         20.6 + (CAST(json_extract_string(props, '$.k') AS INT) % 61) * 0.1::DOUBLE AS lat, 88.0 + (user_id % 47) * 0.1::DOUBLE AS lon
  FROM events)"""
