"""Stand-ins: the tables read as series, polylines, circles and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each user: frames are event ids."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")


def user_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polyline for each user: x grows with the event id or falls, by the user's parity; every tenth has no length."""
    x = F.when(F.col("user_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id"))
    flat = F.col("user_id") % 10 == 3
    return events(spark, sf_dir).select("user_id", "event_id", F.when(flat, 1.0).otherwise(x / 10.0).alias("x"), F.when(flat, 2.0).otherwise(F.col("value")).alias("y"))


def order_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polyline for each order: quantity against price, by line."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )


ORDER_OF_LINES = ["l_linenumber", "l_partkey", "l_suppkey", "y", "x"]


def r6(*names: str) -> list:
    """Columns rounded as both engines are compared."""
    return [F.round(n, 6).alias(n) for n in names]


#: SQL of the stand-ins.
USER_POLYLINES = """
poly AS (SELECT user_id, event_id,
    CASE WHEN user_id % 10 = 3 THEN 1.0::DOUBLE WHEN user_id % 2 = 0 THEN event_id / 10.0::DOUBLE ELSE -event_id / 10.0::DOUBLE END AS x,
    CASE WHEN user_id % 10 = 3 THEN 2.0::DOUBLE ELSE value END AS y
  FROM events)"""
