"""Queries of the smaller operators, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.scalar import display_scale
from seriesforge.operators import circles, raster, tables
from seriesforge.plans.common import r6, table


def sampled_frames(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "orders").groupBy("o_custkey").agg((F.count("*") * 37).alias("total"))
    return raster.sampled_frames(totals, ["o_custkey"], "total", 60)


SAMPLED_FRAMES = """
WITH t AS (SELECT o_custkey, count(*) * 37 AS total FROM orders GROUP BY 1)
SELECT o_custkey, unnest(range(0, total, 60)) AS frame_id FROM t UNION SELECT o_custkey, total // 2 FROM t
"""


def candidate_evidence(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "events").withColumn("score", F.when(F.col("event_type") != "error", F.col("value")))
    return raster.candidate_evidence(scores, ["user_id", "event_type"], "score").select("user_id", "event_type", *r6("evidence_p90", "evidence_median"))


CANDIDATE_EVIDENCE = """
WITH s AS (SELECT user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
SELECT user_id, event_type, round(coalesce(quantile_cont(v, 0.9), 0), 6) AS evidence_p90, round(coalesce(median(v), 0), 6) AS evidence_median FROM s GROUP BY 1, 2
"""


def spine_pixels(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("px"), F.col("l_partkey").alias("py"))
    out = raster.spine_pixels(l, "l_orderkey")
    return out.select("l_orderkey", "length", F.array_join(F.transform("spine", lambda s: F.concat_ws(":", s["px"], s["py"])), " ").alias("spine"))


SPINE_PIXELS = """
SELECT l_orderkey, count(*) AS length, string_agg(l_quantity::BIGINT || ':' || l_partkey, ' ' ORDER BY l_quantity::BIGINT, l_partkey) AS spine FROM lineitem GROUP BY 1
"""


def arbitrated_circles(spark: SparkSession, d: str) -> DataFrame:
    """Per brand: small parts if there are any of size 1, else of size up to 3, else all."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_size")
    return circles.arbitrated([p.where("p_size <= 1"), p.where("p_size <= 3"), p], ["p_brand"])


ARBITRATED_CIRCLES = """
WITH c AS (SELECT p_brand, p_partkey, p_size, unnest([0, 1, 2]) AS choice FROM part),
k AS (SELECT * FROM c WHERE p_size <= CASE choice WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 1000000 END)
SELECT p_brand, p_partkey, p_size, choice FROM k QUALIFY choice = min(choice) OVER (PARTITION BY p_brand)
"""


def resumed_ranges(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 100).alias("range_start"), (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")).alias("range_end"))
    return tables.furthest_end(l, ["l_orderkey"])


RESUMED_RANGES = "SELECT l_orderkey, l_linenumber * 100 AS range_start, max(l_linenumber * 100 + l_quantity::INT) AS range_end FROM lineitem GROUP BY 1, 2"


def training_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with halves of themselves as targets; only even ids have both."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    side = e.where("vec_id % 2 = 0").select("vec_id", F.slice("v", 1, 2).alias("v"))
    top = e.where("vec_id % 3 <> 0").select("vec_id", F.slice("v", 3, 2).alias("v"))
    out = tables.training_matrix(e, side, top, ["vec_id"], "v")
    return out.select("vec_id", F.size("x").cast("long").alias("n_features"), *(F.round(F.get("y", F.lit(i)), 6).alias(f"y{i}") for i in range(4)))


TRAINING_MATRIX = """
SELECT vec_id, len(embedding) AS n_features, round(embedding[1]::DOUBLE, 6) AS y0, round(embedding[2]::DOUBLE, 6) AS y1, round(embedding[3]::DOUBLE, 6) AS y2, round(embedding[4]::DOUBLE, 6) AS y3
FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 3 <> 0
"""


def display_scales(spark: SparkSession, d: str) -> DataFrame:
    scale = display_scale(100 + F.col("p_size") * 37, 80 + F.col("p_partkey") % 900)
    return table(spark, d, "part").select("p_partkey", F.round(scale, 6).alias("scale"))


DISPLAY_SCALES = "SELECT p_partkey, round(least(1, 1280.0::DOUBLE / (100 + p_size * 37), 720.0::DOUBLE / (80 + p_partkey % 900)), 6) AS scale FROM part"

QUERIES = {
    "sampled_frames": (sampled_frames, SAMPLED_FRAMES),
    "candidate_evidence": (candidate_evidence, CANDIDATE_EVIDENCE),
    "spine_pixels": (spine_pixels, SPINE_PIXELS),
    "arbitrated_circles": (arbitrated_circles, ARBITRATED_CIRCLES),
    "resumed_ranges": (resumed_ranges, RESUMED_RANGES),
    "training_matrix": (training_matrix, TRAINING_MATRIX),
    "display_scales": (display_scales, DISPLAY_SCALES),
}
