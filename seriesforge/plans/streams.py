"""Queries of the streaming operators and of resumable runs, each with the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.staging import new_path
from seriesforge.plans.circles import TRACK_CENTRES
from seriesforge.plans.common import r6, table
from seriesforge.plans.series import LARGEST_GAP_CLUSTER
from seriesforge.streaming import runs, tracking

#: Parts in which a table arrives, in order of its events.
PARTS = 4


def arriving(rows: DataFrame, order: str, by: str, last: DataFrame | None = None) -> DataFrame:
    """The rows as a stream of files, a part of the order after the other; inside a part, one file for each group of ``by``; ``last`` comes last."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession)
    low, high = rows.agg(F.coalesce(F.min(order), F.lit(0)), F.coalesce(F.max(order), F.lit(0))).first()
    part = F.least(F.floor((F.col(order) - low) * PARTS / (high - low + 1)), F.lit(PARTS - 1))
    for i in range(PARTS):
        rows.where(part == i).repartition(2, by).write.mode("append").parquet(path)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def streamed_tracks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    frames = e.select(F.col("user_id").alias("recording"), F.col("event_id").alias("frame_id"), (F.col("value") % 16 - 8).alias("dx"), (F.col("event_id") % 9 - 4.0).alias("dy"))
    out = runs.drained(tracking.tracked_stream(arriving(frames, "frame_id", "recording"), 100.0, 50.0), new_path(spark))
    return out.select(F.col("recording").alias("user_id"), F.col("frame_id").alias("event_id"), *r6("cx", "cy"))


def streamed_gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Events a second apart; a last one, far ahead and of no user, lets the watermark close all others."""
    e = table(spark, d, "events").select(F.col("user_id").cast("long").alias("series"), F.col("event_id").cast("long").alias("place"), "value")
    end = e.agg(F.lit(-1).cast("long").alias("series"), (F.coalesce(F.max("place"), F.lit(0)) + 1_000_000).alias("place"), F.lit(0.0).alias("value"))
    points = arriving(e, "place", "series", end).withColumn("ts", F.timestamp_seconds(F.col("place") + 1))  # a watermark begins at 0 and takes rows up to it for late
    out = runs.drained(tracking.gap_sessions(points, 50.0, "10 seconds", 600_000), new_path(spark)).where("series >= 0")
    return out.select(F.col("series").alias("user_id"), F.col("place").alias("event_id"), "value", "cluster")


def resumed_run(spark: SparkSession, d: str) -> DataFrame:
    """Means of chunks of a hundred events for each kind, by a run that ends after three batches and one that goes on."""
    e = table(spark, d, "events").withColumn("chunk", F.floor(F.col("event_id") / 100)).select("event_type", "chunk", "value")
    ranges, path = e.select("event_type", "chunk").distinct(), new_path(spark)

    def process(some: DataFrame) -> DataFrame:
        return e.join(some, ["event_type", "chunk"]).groupBy("event_type", "chunk").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))

    runs.run_ranges(ranges, ["event_type", "chunk"], process, path, most=3)
    runs.run_ranges(ranges, ["event_type", "chunk"], process, path)
    return runs.finished(spark, path).select("event_type", "chunk", *r6("mean"), "n")


QUERIES = {
    "streamed_tracks": (streamed_tracks, TRACK_CENTRES),
    "streamed_gap_clusters": (streamed_gap_clusters, LARGEST_GAP_CLUSTER),
    "resumed_run": (resumed_run, "SELECT event_type, event_id // 100 AS chunk, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2"),
}
