"""Runs that may stop anywhere and go on: a manifest says which ranges are done, and folders that it doesn't name don't count."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def run_ranges(ranges: DataFrame, key: list[str], process: Callable[[DataFrame], DataFrame], path: str, batches: int = 8, most: int | None = None) -> int:
    """Processes the ranges that the manifest doesn't hold, batch by batch, and returns how many batches it did.

    A batch is dealt by hash of the key. Its rows go to a folder of their own;
    then one small file adds its ranges to the manifest, under that folder's
    name. A run that ends between the two leaves a folder that no reader looks
    at, and the next run does the batch again. ``most`` ends a run after so many
    batches. Ranges with a null key are left out: they could not be found again.
    """
    spark = ranges.sparkSession
    done = 0
    left = ranges.dropna(subset=key)
    if (manifest := _read(spark, f"{path}/manifest")) is not None:
        left = left.join(manifest.select(*key).distinct(), key, "left_anti")
    batch = F.pmod(F.xxhash64(*key), F.lit(batches))
    for i in [r[0] for r in left.select(batch.cast("int").alias("b")).distinct().orderBy("b").collect()]:  # numbers below ``batches``
        if most is not None and done >= most:
            break
        own, name = left.where(batch == i), uuid.uuid4().hex
        process(own).write.parquet(f"{path}/rows/batch={name}")
        own.select(*key).distinct().withColumn("batch", F.lit(name)).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        done += 1
    return done


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all batches that the manifest names; none before the first."""
    manifest, rows = _read(spark, f"{path}/manifest"), _read(spark, f"{path}/rows")
    if manifest is None or rows is None:
        return None
    return rows.join(F.broadcast(manifest.select("batch").distinct()), "batch", "left_semi").drop("batch")  # as many names as batches


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch has a folder of its own, which a repetition of the batch overwrites."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={number}")

    return write


def drained(stream: DataFrame, path: str) -> DataFrame:
    """All rows that a stream gives for what its source holds now, written by ``batch_writer`` beside the stream's checkpoint."""
    spark = stream.sparkSession
    query = stream.writeStream.foreachBatch(batch_writer(f"{path}/rows")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)
