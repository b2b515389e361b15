"""Scans, sinks and catalogues of measurement files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.functions.ranking import positioned

#: One row a frame: length in pixels, mean thickness, curve as text.
SPINE_SCHEMA = T.StructType(
    [T.StructField("Frame_ID", T.StringType()), T.StructField("Length_px", T.IntegerType()), T.StructField("Avg_Thickness_px", T.DoubleType()), T.StructField("Spine_Coords", T.StringType())]
)
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv")
INTENSITY_WANTED, INTENSITY_EXCLUDED = ("speckle", "led", "fib"), ("side", "top", "combined", "segmented")
SEGMENTATION_EXCLUDED = ("speckle", "combined")


def read_spines(spark: SparkSession, path: str) -> DataFrame:
    """Spine tables with the recording and view that their file names hold."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = spark.read.csv(path, header=True, schema=SPINE_SCHEMA, quote='"', escape='"').select("*", F.url_decode(name).alias("_name"))
    parts = r"^(\d{4}-\d\d-\d\d \d\d-\d\d-\d\d) (Side|Topview|Top)_data"
    view = F.lower(F.regexp_extract("_name", parts, 2))
    return rows.withColumn("recording", F.regexp_extract("_name", parts, 1)).withColumn("view", F.when(view == "topview", "top").otherwise(view)).drop("_name")


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A wide table whose number of columns varies; types are found in the data."""
    return spark.read.csv(path, header=True, inferSchema=True)


def write_table(df: DataFrame, path: str, partitions: list[str] | None = None, force: bool = True) -> None:
    """Parquet; an existing table stays unless ``force``."""
    writer = df.write.mode("overwrite" if force else "ignore")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def pivoted(df: DataFrame, key: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide: one column for each of ``names``, in that order."""
    return df.groupBy(*key).pivot(name, names).agg(F.first(value))


def read_json_states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file; a corrupt one gives nulls."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("state")).select("state.*")


def _any(name: Column, tokens: tuple[str, ...]) -> Column:
    return name.rlike("|".join(map(re.escape, tokens)))


def intensity_videos(files: DataFrame, path: str = "path") -> DataFrame:
    """Files that an intensity run takes: mp4, of a wanted kind, of no excluded kind."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return files.where(name.endswith(".mp4") & _any(name, INTENSITY_WANTED) & ~_any(name, INTENSITY_EXCLUDED))


def segmentation_videos(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Files that a segmentation run takes, with ``rank``: smallest first, then by path, then by the other columns in turn, so that no tie is left open."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    found = files.where(F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*VIDEO_EXTENSIONS) & ~_any(name, SEGMENTATION_EXCLUDED))
    others = [c for c in files.columns if c not in (size, path)]
    return positioned(found, [size, F.lower(F.col(path)), path, *others], "rank").withColumn("rank", F.col("rank") + 1)


def segmented_sources(files: DataFrame, path: str = "path") -> DataFrame:
    """(source): recordings of which a segmented file, whole or in chunks, exists."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    ours = files.where(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*VIDEO_EXTENSIONS) & stem.contains("_segmented"))
    source = F.when(stem.contains("__"), F.split(stem, "__")[0]).otherwise(F.regexp_replace(stem, r"^(.*)_segmented.*$", "$1"))
    return ours.select(source.alias("source")).where("source <> ''").distinct()


def first_existing(wanted: DataFrame, existing: DataFrame, key: list[str], name: str = "name", priority: str = "priority") -> DataFrame:
    """Per key, the existing candidate of the first priority."""
    found = wanted.join(existing.select(name).distinct(), name, "left_semi")
    return found.groupBy(*key).agg(F.min_by(name, priority).alias(name), F.min(priority).alias(priority))


def resolved(wanted: DataFrame, existing: DataFrame, key: list[str], name: str = "name") -> DataFrame:
    """Per key, the existing file that its name means: itself, with .mp4, with LED or Fib and .mp4, else one of the same stem in any case.

    Ties go to the first name. Returns key, name, priority (0 to 4).
    """
    there = existing.select(F.col(name).alias("_file")).distinct()
    asked = wanted.select(*key, F.posexplode(F.array(*(F.concat(name, F.lit(end)) for end in ("", ".mp4", " LED.mp4", " Fib.mp4")))).alias("priority", "_file"))
    direct = asked.join(there, "_file")
    stems = there.select("_file", F.lower(F.regexp_replace("_file", r"\.[^.]+$", "")).alias("_stem"))
    alike = wanted.select(*key, F.lower(name).alias("_stem")).join(stems, "_stem").select(*key, F.lit(4).alias("priority"), "_file")
    best = direct.select(*key, "priority", "_file").unionByName(alike).groupBy(*key).agg(F.min(F.struct("priority", "_file")).alias("_best"))
    return best.select(*key, F.col("_best._file").alias(name), F.col("_best.priority").alias("priority"))
