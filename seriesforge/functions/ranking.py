"""Positions in the order of a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesforge.functions.staging import staged


def positioned(df: DataFrame, order: list[str | Column], position: str, total: str | None = None) -> DataFrame:
    """Adds each row's position (from 0) in the order of all rows, and the number of rows as ``total``.

    Rows are sorted in ranges and staged; a row's position is its place in its
    range and the rows of the ranges before, of which there are as many as
    shuffle partitions.
    """
    rows = staged(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftrightunsigned("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(2**33 - 1))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    w = W.partitionBy(F.lit(0)).orderBy("_range")  # a row for each range
    counts = counts.select("_range", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("_total"))
    out = rows.join(F.broadcast(counts), "_range").withColumn(position, F.col("_before") + F.col("_place"))
    return (out.withColumn(total, F.col("_total")) if total else out).drop("_id", "_range", "_place", "_before", "_total")
