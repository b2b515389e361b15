"""Queries of the series operators, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.staging import staged
from seriesforge.operators import series as s
from seriesforge.plans.common import ORDER_OF_LINES, USER_POLYLINES, events, order_polylines, r6, table, user_polylines

KEY, ORDER = ["user_id"], ["event_id"]


def arc_length(spark: SparkSession, d: str) -> DataFrame:
    out = s.arc_length(order_polylines(spark, d), ["l_orderkey"], ORDER_OF_LINES)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *r6("x", "y", "arc"))


ARC_LENGTH = """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, l_extendedprice AS y FROM lineitem),
q AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM p
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, y, x))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x, 6) AS x, round(y, 6) AS y,
  round(sum(step) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, y, x ROWS UNBOUNDED PRECEDING), 6) AS arc
FROM q
"""


def resample_20(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: 20-point features of each polyline, scaled over all of them."""
    out = s.feature_polyline(user_polylines(spark, d), KEY, ORDER, 20)
    return out.select("user_id", "point", *r6("x", "y"))


def resample_40(spark: SparkSession, d: str) -> DataFrame:
    return s.clean_polyline(user_polylines(spark, d), KEY, ORDER, 40).select("user_id", "point", *r6("x", "y"))


def features_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Resampled, turned, and scaled by one range of x and one of y for each event parity of users."""
    out = staged(s.feature_polyline(user_polylines(spark, d), KEY, ORDER, 20).withColumn("view", F.col("user_id") % 2))  # read for its ranges and for the result
    return s.scaled_coords(out, ["view"], ["x", "y"]).select("user_id", "point", *r6("x", "y"))


def resample_ctes(n: int, clean: bool) -> str:
    """From ``poly`` (user_id, event_id, x, y) to ``o`` (user_id, point, x, y)."""
    turn = "CASE WHEN first_x < last_x THEN cnt - 1 - rk ELSE rk END" if clean else "rk"
    flat_s = "pos::DOUBLE" if clean else "NULL"
    out = "point" if clean else f"CASE WHEN max(CASE WHEN point = 0 THEN x END) OVER u < max(CASE WHEN point = {n - 1} THEN x END) OVER u THEN {n - 1} - point ELSE point END AS point"
    return f"""
a AS (SELECT *, row_number() OVER w - 1 AS rk, count(*) OVER (PARTITION BY user_id) AS cnt,
        first_value(x) OVER w AS first_x, last_value(x) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_x
      FROM poly WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT user_id, x, y, cnt, {turn} AS pos FROM a WHERE cnt > 1),
c AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM b WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
e AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS arc, sum(step) OVER (PARTITION BY user_id) AS total FROM c),
f AS (SELECT *, CASE WHEN total <= 0 THEN {flat_s} ELSE arc END AS s0, CASE WHEN total <= 0 THEN cnt - 1 ELSE max(arc) OVER (PARTITION BY user_id) END AS whole FROM e),
g AS (SELECT *, lead(s0) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM f WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
k AS (SELECT unnest(range(0, {n})) AS point),
h AS (SELECT user_id, point, x + (x1 - x) * ((CASE WHEN point = {n - 1} THEN whole ELSE whole * point / {n - 1} END) - s0) / (s1 - s0) AS x,
             y + (y1 - y) * ((CASE WHEN point = {n - 1} THEN whole ELSE whole * point / {n - 1} END) - s0) / (s1 - s0) AS y
      FROM g, k WHERE s1 > s0 AND ((point < {n - 1} AND s0 <= whole * point / {n - 1} AND whole * point / {n - 1} < s1) OR (point = {n - 1} AND s1 = whole))
      UNION ALL SELECT user_id, point, x, y FROM g, k WHERE total <= 0 AND pos = 0 AND s0 IS NULL),
o AS (SELECT user_id, {out}, x, y FROM h WINDOW u AS (PARTITION BY user_id))"""


def _resample_sql(n: int, clean: bool, scaled: bool = False) -> str:
    final = f"""
SELECT user_id, point, round(x, 6) AS x, round(y, 6) AS y FROM o""" if not scaled else """
SELECT user_id, point,
  round(CASE WHEN max(x) OVER v > min(x) OVER v THEN (x - min(x) OVER v) / (max(x) OVER v - min(x) OVER v) ELSE x END, 6) AS x,
  round(CASE WHEN max(y) OVER v > min(y) OVER v THEN (y - min(y) OVER v) / (max(y) OVER v - min(y) OVER v) ELSE y END, 6) AS y
FROM o WINDOW v AS (PARTITION BY user_id % 2)"""
    return f"WITH {USER_POLYLINES},{resample_ctes(n, clean)}\n{final}"


def largest_gap_cluster(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    step = F.abs(F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy("event_id")))
    return s.largest_cluster(events(spark, d), KEY, ORDER, F.coalesce(step, F.lit(0.0))).select("user_id", "event_id", "value", "cluster")


LARGEST_GAP_CLUSTER = """
WITH a AS (SELECT user_id, event_id, value, CASE WHEN abs(value - lag(value) OVER w) > 50 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM a),
c AS (SELECT user_id, cluster, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, cluster) AS r FROM b GROUP BY user_id, cluster)
SELECT user_id, event_id, value, cluster FROM b JOIN c USING (user_id, cluster) WHERE r = 1
"""


def interpolate_missing(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return s.interpolated(rows, KEY, ORDER, "value", "filled").select("user_id", "event_id", *r6("filled"))


INTERPOLATE_MISSING = """
WITH a AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
b AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN p END) OVER (PARTITION BY user_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS p0,
             min(CASE WHEN v IS NOT NULL THEN p END) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM a)
SELECT b.user_id, b.event_id, round(CASE WHEN b.v IS NOT NULL THEN b.v WHEN x.v IS NULL THEN y.v WHEN y.v IS NULL THEN x.v
    ELSE x.v + (y.v - x.v) * (b.p - b.p0) / (b.p1 - b.p0) END, 6) AS filled
FROM b LEFT JOIN a x ON x.user_id = b.user_id AND x.p = b.p0 LEFT JOIN a y ON y.user_id = b.user_id AND y.p = b.p1
"""


def _savgol(degree: int, least: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return s.savgol(events(spark, d), KEY, ORDER, "value", "smooth", degree, least).select("user_id", "event_id", *r6("smooth"))

    return run


def weights_sql(degree: int, least: int) -> str:
    rows = [f"({k},{i},{j},{w!r}::DOUBLE)" for k in range(max(least, degree + 1) | 1, 32, 2) for i, r in enumerate(s.savgol_weights(k, degree)) for j, w in enumerate(r)]
    return ",".join(rows)


def _savgol_ctes(degree: int, least: int) -> str:
    return f"""
wt(w, i, j, c) AS (VALUES {weights_sql(degree, least)}),
a AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
b AS (SELECT *, least(31, n - (1 - n % 2)) AS w FROM a),
c AS (SELECT *, greatest(0, least(i - w // 2, n - w)) AS st FROM b),
sm AS (SELECT c.user_id, c.event_id, c.i, c.n, coalesce(sum(wt.c * y.value), any_value(c.value)) AS smooth
  FROM c LEFT JOIN wt ON wt.w = c.w AND wt.i = c.i - c.st LEFT JOIN a y ON y.user_id = c.user_id AND y.i = c.st + wt.j
  GROUP BY ALL)"""


def _savgol_sql(degree: int, least: int) -> str:
    return f"WITH {_savgol_ctes(degree, least)} SELECT user_id, event_id, round(smooth, 6) AS smooth FROM sm"


def gradient(spark: SparkSession, d: str) -> DataFrame:
    return s.gradient(events(spark, d), KEY, ORDER, "value", "slope").select("user_id", "event_id", *r6("slope"))


GRADIENT = """
SELECT user_id, event_id, round(coalesce((lead(value) OVER w - lag(value) OVER w) / 2, lead(value) OVER w - value, value - lag(value) OVER w), 6) AS slope
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
"""


def intensity_derivative(spark: SparkSession, d: str) -> DataFrame:
    smooth = s.savgol(events(spark, d), KEY, ORDER, "value", "smooth", 3, 5)
    return s.gradient(smooth, KEY, ORDER, "smooth", "slope").select("user_id", "event_id", *r6("slope"))


INTENSITY_DERIVATIVE = f"""WITH {_savgol_ctes(3, 5)}
SELECT user_id, event_id, round(coalesce((lead(smooth) OVER w - lag(smooth) OVER w) / 2, lead(smooth) OVER w - smooth, smooth - lag(smooth) OVER w), 6) AS slope
FROM sm WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
"""


def minmax_coords(spark: SparkSession, d: str) -> DataFrame:
    rows = order_polylines(spark, d).withColumn("view", F.col("l_linenumber"))
    rows = rows.withColumn("x", F.when(F.col("view") == 7, 3.0).otherwise(F.col("x")))
    return s.scaled_coords(rows, ["view"], ["x", "y"]).groupBy("l_orderkey", "view").agg(*(F.round(F.sum(c), 6).alias(c) for c in ("x", "y")))


MINMAX_COORDS = """
WITH p AS (SELECT l_orderkey, l_linenumber AS view, CASE WHEN l_linenumber = 7 THEN 3.0::DOUBLE ELSE l_quantity END AS x, l_extendedprice AS y FROM lineitem),
m AS (SELECT view, min(x) a, max(x) b, min(y) c, max(y) e FROM p GROUP BY view)
SELECT l_orderkey, view, round(sum(CASE WHEN b > a THEN (x - a) / (b - a) ELSE x END), 6) AS x, round(sum(CASE WHEN e > c THEN (y - c) / (e - c) ELSE y END), 6) AS y
FROM p JOIN m USING (view) GROUP BY l_orderkey, view
"""


def minmax_intensity(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("value", F.when(F.col("user_id") == 0, 7.0).otherwise(F.col("value")))
    return s.scaled_intensity(rows, KEY, "value", "scaled").select("user_id", "event_id", *r6("scaled"))


MINMAX_INTENSITY = """
WITH p AS (SELECT user_id, event_id, CASE WHEN user_id = 0 THEN 7.0::DOUBLE ELSE value END AS v FROM events)
SELECT user_id, event_id, round(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0), 6) AS scaled FROM p WINDOW w AS (PARTITION BY user_id)
"""


def baseline_subtract(spark: SparkSession, d: str) -> DataFrame:
    return s.baseline_removed(events(spark, d), KEY, ORDER, "value", "lifted").select("user_id", "event_id", *r6("lifted"))


BASELINE_SUBTRACT = """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
b AS (SELECT user_id, avg(value) AS base FROM a WHERE r <= 5 GROUP BY user_id)
SELECT user_id, event_id, round(value - base, 6) AS lifted FROM a JOIN b USING (user_id)
"""


def tip_outlier_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("x", F.col("value")).withColumn("y", F.col("event_id") % 17 * 1.0)
    return s.outlier_gate(rows, KEY, ["x", "y"]).select("user_id", "event_id", F.when(~F.col("outlier"), F.round("x", 6)).alias("x"), "outlier")


TIP_OUTLIER_GATE = """
WITH p AS (SELECT user_id, event_id, value AS x, (event_id % 17)::DOUBLE AS y FROM events),
g AS (SELECT user_id, avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy FROM p GROUP BY user_id),
o AS (SELECT p.*, abs(x - mx) > 2 * sx OR abs(y - my) > 2 * sy AS outlier FROM p JOIN g USING (user_id))
SELECT user_id, event_id, CASE WHEN NOT outlier THEN round(x, 6) END AS x, outlier FROM o
"""


def split_gap_buffer(spark: SparkSession, d: str) -> DataFrame:
    return s.head_tail_split(table(spark, d, "embeddings").select("vec_id", "label"), ["vec_id"], ["label"]).select("vec_id", "label", "split")


SPLIT_GAP_BUFFER = """
WITH a AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, label, CASE WHEN i < floor(n / 10.0::DOUBLE) * 8 THEN 'train' WHEN i >= floor(n / 10.0::DOUBLE * 8.25::DOUBLE) THEN 'test' END AS split FROM a
"""

QUERIES = {
    "arc_length": (arc_length, ARC_LENGTH),
    "resample_polyline_20": (resample_20, _resample_sql(20, clean=False)),
    "resample_polyline_40": (resample_40, _resample_sql(40, clean=True)),
    "features_scaled": (features_scaled, _resample_sql(20, clean=False, scaled=True)),
    "largest_gap_cluster": (largest_gap_cluster, LARGEST_GAP_CLUSTER),
    "interpolate_missing": (interpolate_missing, INTERPOLATE_MISSING),
    "savgol_w31_p2": (_savgol(2, 7), _savgol_sql(2, 7)),
    "savgol_w31_p3": (_savgol(3, 5), _savgol_sql(3, 5)),
    "gradient": (gradient, GRADIENT),
    "intensity_derivative": (intensity_derivative, INTENSITY_DERIVATIVE),
    "minmax_coords": (minmax_coords, MINMAX_COORDS),
    "minmax_intensity": (minmax_intensity, MINMAX_INTENSITY),
    "baseline_subtract": (baseline_subtract, BASELINE_SUBTRACT),
    "tip_outlier_gate": (tip_outlier_gate, TIP_OUTLIER_GATE),
    "split_gap_buffer": (split_gap_buffer, SPLIT_GAP_BUFFER),
}
