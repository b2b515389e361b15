"""Queries of the circle operators, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import circles as c
from seriesforge.plans.common import r6, table


def _circles(spark: SparkSession, d: str) -> DataFrame:
    """Detections made of parts: a recording for every 100 of them, so recordings grow in number, not in size."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.floor(k / 100).alias("g"), k.alias("ord"), (k * 37 % 200).cast("double").alias("x"), (k * 91 % 150).cast("double").alias("y"), (10 + F.col("p_size") % 30).cast("double").alias("r"), (k % 100 % 12).alias("frame")
    )


CIRCLES = """c AS (SELECT p_partkey // 100 AS g, p_partkey AS ord, (p_partkey * 37 % 200)::DOUBLE AS x, (p_partkey * 91 % 150)::DOUBLE AS y, (10 + p_size % 30)::DOUBLE AS r, p_partkey % 100 % 12 AS frame FROM part)"""

#: The first cluster whose mean is near takes the detection: one step for each detection of a recording.
CLUSTERS = f"""{CIRCLES},
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ord) AS i FROM c),
st(g, i, cl) AS (SELECT DISTINCT g, 0::BIGINT, []::STRUCT(n BIGINT, x DOUBLE, y DOUBLE, r DOUBLE, f BIGINT[])[] FROM c
  UNION ALL SELECT g, i, CASE WHEN m IS NULL THEN list_append(cl, {{'n': 1::BIGINT, 'x': x, 'y': y, 'r': r, 'f': [frame]}})
    ELSE list_transform(cl, lambda k, j: CASE WHEN j = m THEN {{'n': k.n + 1, 'x': k.x + x, 'y': k.y + y, 'r': k.r + r, 'f': list_distinct(list_append(k.f, frame))}} ELSE k END) END
  FROM (SELECT n.g, n.i, n.x, n.y, n.r, n.frame, st.cl, list_filter(range(1, len(st.cl) + 1), lambda j: sqrt(pow(n.x - st.cl[j].x / st.cl[j].n, 2) + pow(n.y - st.cl[j].y / st.cl[j].n, 2)) <= 18 AND abs(n.r - st.cl[j].r / st.cl[j].n) <= 14)[1] AS m
    FROM st JOIN n ON n.g = st.g AND n.i = st.i + 1)),
e AS (SELECT g, cl FROM st QUALIFY i = max(i) OVER (PARTITION BY g)),
k AS (SELECT g, unnest(range(len(cl))) AS cluster, cl FROM e),
cs AS (SELECT g, cluster, cl[cluster + 1].x / cl[cluster + 1].n AS x, cl[cluster + 1].y / cl[cluster + 1].n AS y, cl[cluster + 1].r / cl[cluster + 1].n AS r, cl[cluster + 1].n AS n, len(cl[cluster + 1].f) AS support FROM k)"""


def greedy(of: str, conflict: str, most: str = "2147483647") -> str:
    """Rows of ``of`` (g, rk, id, x, y, r, ...) kept in rank order unless they conflict with a kept one."""
    return f"""
cf AS (SELECT b.g, b.rk, b.id, any_value({most}) AS most, coalesce(list(a.id) FILTER (WHERE a.id IS NOT NULL), []) AS bad FROM {of} b LEFT JOIN {of} a ON a.g = b.g AND a.rk < b.rk AND ({conflict}) GROUP BY b.g, b.rk, b.id),
gr(g, i, kept) AS (SELECT DISTINCT g, 0::BIGINT, []::BIGINT[] FROM cf
  UNION ALL SELECT cf.g, cf.rk, CASE WHEN len(gr.kept) >= cf.most OR list_has_any(gr.kept, cf.bad) THEN gr.kept ELSE list_append(gr.kept, cf.id) END FROM gr JOIN cf ON cf.g = gr.g AND cf.rk = gr.i + 1),
ke AS (SELECT g, unnest(kept) AS id FROM (SELECT * FROM gr QUALIFY i = max(i) OVER (PARTITION BY g)))"""


DISTANCE = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"


def circle_order(spark: SparkSession, d: str) -> DataFrame:
    return c.stable_order(_circles(spark, d), ["g"], ["ord"]).select("g", "ord", "circle")


CIRCLE_ORDER = f"WITH {CIRCLES} SELECT g, ord, row_number() OVER (PARTITION BY g ORDER BY y::INT, x::INT, ord) - 1 AS circle FROM c"


def leader_cluster(spark: SparkSession, d: str) -> DataFrame:
    return c.leader_clusters(_circles(spark, d), ["g"], "ord").select("g", "cluster", *r6("x", "y", "r"), "n", "support")


LEADER_CLUSTER = f"WITH RECURSIVE {CLUSTERS} SELECT g, cluster, round(x, 6) AS x, round(y, 6) AS y, round(r, 6) AS r, n, support FROM cs"


def nms_circles(spark: SparkSession, d: str) -> DataFrame:
    rows = c.leader_clusters(_circles(spark, d), ["g"], "ord")
    rank = [-F.col("support"), F.round(F.abs(F.col("r") - 80.0), 9), F.col("cluster")]
    return c.non_overlapping(rows, ["g"], rank, 0.72).select("g", "cluster", *r6("x", "y", "r"))


NMS_CIRCLES = f"""WITH RECURSIVE {CLUSTERS},
v AS (SELECT g, cluster AS id, x, y, r, row_number() OVER (PARTITION BY g ORDER BY support DESC, round(abs(r - 80), 9), cluster) AS rk FROM cs), {greedy("v", DISTANCE + " < 0.72::DOUBLE * least(a.r, b.r)")}
SELECT g, id AS cluster, round(x, 6) AS x, round(y, 6) AS y, round(r, 6) AS r FROM ke JOIN v USING (g, id)
"""


def nms_temporal(spark: SparkSession, d: str) -> DataFrame:
    rows = c.leader_clusters(_circles(spark, d), ["g"], "ord").withColumn("frames", F.lit(20))
    return c.temporal_selection(rows, ["g"], "frames", low=2).select("g", "cluster", *r6("x", "y", "r"))


NMS_TEMPORAL = f"""WITH RECURSIVE {CLUSTERS},
s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY support DESC, r DESC, cluster) AS rk0 FROM cs WHERE support >= least(40, greatest(2, ceil(20 * 0.07::DOUBLE)))),
f AS (SELECT g, median(r) AS ref FROM s WHERE rk0 <= 12 GROUP BY g),
v AS (SELECT s.g, cluster AS id, x, y, r, row_number() OVER (PARTITION BY s.g ORDER BY rk0) AS rk FROM s JOIN f ON f.g = s.g WHERE r BETWEEN 0.70::DOUBLE * ref AND 1.30::DOUBLE * ref), {greedy("v", DISTANCE + " < 0.80::DOUBLE * least(a.r, b.r)")}
SELECT g, id AS cluster, round(x, 6) AS x, round(y, 6) AS y, round(r, 6) AS r FROM ke JOIN v USING (g, id)
"""


def layout_select(spark: SparkSession, d: str) -> DataFrame:
    rows = c.leader_clusters(_circles(spark, d), ["g"], "ord").withColumn("frames", F.lit(3)).withColumn("target", (3 + F.col("g") % 6).cast("int"))
    rows = rows.withColumn("evidence_p90", (F.col("cluster") * 7 % 30).cast("double")).withColumn("evidence_median", (F.col("cluster") * 3 % 20).cast("double"))
    return c.layout_selection(rows, ["g"], "frames", "target", low=2).select("g", "cluster", *r6("x", "y", "r"), "factor")


LAYOUT_SELECT = f"""WITH RECURSIVE {CLUSTERS},
f AS (SELECT g, median(r) AS ref FROM cs WHERE support >= 3 * 0.55::DOUBLE GROUP BY g),
s AS (SELECT cs.g AS g0, cluster, x, y, r, ref, 3 + cs.g % 6 AS target, round(ln(1 + support) + 0.08::DOUBLE * (cluster * 7 % 30) + 0.03::DOUBLE * (cluster * 3 % 20) - 0.6::DOUBLE * abs(r - ref) / ref, 9) AS score
  FROM cs JOIN f ON f.g = cs.g WHERE support >= greatest(2, ceil(3 * 0.04::DOUBLE)) AND r BETWEEN 0.78::DOUBLE * ref AND 1.22::DOUBLE * ref),
v AS (SELECT g0 * 1000 + (fac * 100)::INT AS g, g0, fac, cluster AS id, x, y, r, ref, target, row_number() OVER (PARTITION BY g0, fac ORDER BY score DESC, cluster) AS rk FROM s, (VALUES (1.85::DOUBLE), (1.70), (1.55), (1.40)) q(fac)),
{greedy("v", DISTANCE + " < b.fac * b.ref", "b.target")},
o AS (SELECT v.* FROM ke JOIN v USING (g, id) QUALIFY count(*) OVER (PARTITION BY v.g) = target)
SELECT g0 AS g, id AS cluster, round(x, 6) AS x, round(y, 6) AS y, round(ref, 6) AS r, fac AS factor FROM o QUALIFY fac = max(fac) OVER (PARTITION BY g0)
"""


def min_support(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))
    return out.select("event_type", "n", c.least_support(F.col("n")).cast("long").alias("least"))


MIN_SUPPORT = "SELECT event_type, count(DISTINCT user_id) AS n, least(40, greatest(8, ceil(count(DISTINCT user_id) * 0.07::DOUBLE)))::BIGINT AS least FROM events GROUP BY 1"


def consensus_shift(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", (F.col("value") % 60 - 30).alias("dx"), (F.col("event_id") * 7 % 41 - 20.0).alias("dy"))
    return c.consensus_shift(e, ["user_id"], 22.0).select("user_id", *r6("dx", "dy"))


CONSENSUS_SHIFT = """
WITH a AS (SELECT user_id, value % 60 - 30 AS dx, (event_id * 7 % 41 - 20)::DOUBLE AS dy FROM events),
b AS (SELECT * FROM a WHERE sqrt(dx * dx + dy * dy) <= 22),
m AS (SELECT user_id, median(dx) mx, median(dy) my FROM b GROUP BY 1),
i AS (SELECT user_id, median(dx) ix, median(dy) iy FROM b JOIN m USING (user_id) WHERE sqrt(pow(dx - mx, 2) + pow(dy - my, 2)) <= 7 GROUP BY 1),
r AS (SELECT user_id, coalesce(ix, mx, 0) AS x, coalesce(iy, my, 0) AS y FROM (SELECT DISTINCT user_id FROM a) LEFT JOIN m USING (user_id) LEFT JOIN i USING (user_id))
SELECT user_id, round(x * least(1, 22 / nullif(sqrt(x * x + y * y), 0)), 6) AS dx, round(y * least(1, 22 / nullif(sqrt(x * x + y * y), 0)), 6) AS dy FROM r
"""


def track_centres(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.lit(100.0).alias("x0"), F.lit(50.0).alias("y0"), (F.col("value") % 16 - 8).alias("dx"), (F.col("event_id") % 9 - 4.0).alias("dy"))
    return c.tracked(e, ["user_id"], "event_id").select("user_id", "event_id", *r6("cx", "cy"))


TRACK_CENTRES = """
WITH RECURSIVE n AS (SELECT user_id, event_id, value % 16 - 8 AS dx, (event_id % 9 - 4)::DOUBLE AS dy, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
t(user_id, event_id, i, cx, cy) AS (SELECT user_id, event_id, i, 100 + dx, 50 + dy FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.event_id, n.i, t.cx + 0.7::DOUBLE * n.dx, t.cy + 0.7::DOUBLE * n.dy FROM t JOIN n ON n.user_id = t.user_id AND n.i = t.i + 1)
SELECT user_id, event_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM t
"""


def refine_radius(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select((k % 300).alias("circle"), (k * 53 % 160).cast("double").alias("brightness"), F.col("p_size").cast("double").alias("r"), F.lit(33.0).alias("r0"))
    return c.refined_radius(rows, ["circle"]).select("circle", "n", "bright", *r6("r"))


REFINE_RADIUS = """
WITH p AS (SELECT p_partkey % 300 AS circle, (p_partkey * 53 % 160)::DOUBLE AS b, p_size::DOUBLE AS r FROM part),
q AS (SELECT circle, greatest(70, quantile_cont(b, 0.7)) AS cut, count(*) AS n, median(r) AS a FROM p GROUP BY 1),
s AS (SELECT circle, count(*) FILTER (WHERE b >= cut) AS bright, median(r) FILTER (WHERE b >= cut) AS m FROM p JOIN q USING (circle) GROUP BY 1)
SELECT circle, n, bright, round(CASE WHEN n < 5 THEN 33 WHEN bright >= 5 THEN m ELSE a END, 6) AS r FROM q JOIN s USING (circle)
"""


def stabilize_radii(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 700).alias("g"), F.col("p_size").cast("double").alias("r"))
    return c.stabilised_radii(rows, ["g"]).select("p_partkey", "g", *r6("r"))


STABILIZE_RADII = """
WITH p AS (SELECT p_partkey, p_partkey % 700 AS g, p_size::DOUBLE AS r FROM part),
m AS (SELECT g, median(r) AS m, count(*) AS n FROM p GROUP BY 1),
f AS (SELECT g, median(r) AS ref FROM p JOIN m USING (g) WHERE r >= m GROUP BY 1)
SELECT p_partkey, g, round(CASE WHEN n >= 3 AND m > 0 AND (r < ref * 0.70::DOUBLE OR r > ref * 1.30::DOUBLE) THEN ref ELSE r END, 6) AS r FROM p JOIN m USING (g) JOIN f USING (g)
"""


def nearest_candidate(spark: SparkSession, d: str) -> DataFrame:
    rows = _circles(spark, d)
    circles = rows.where("frame = 0").select("g", F.col("ord").alias("circle"), "x", "y", "r")
    candidates = rows.where("frame > 0").select("g", F.col("ord").alias("candidate"), "x", "y", "r")
    return c.nearest_candidate(circles, candidates, ["g"], 35.0, 1.5).select("g", "circle", "candidate", *r6("score"))


NEAREST_CANDIDATE = f"""WITH {CIRCLES},
p AS (SELECT a.g, a.ord AS circle, b.ord AS candidate, {DISTANCE} AS dist, {DISTANCE} + 1.5::DOUBLE * abs(a.r - b.r) AS score FROM c a JOIN c b ON a.g = b.g AND a.frame = 0 AND b.frame > 0)
SELECT g, circle, candidate, round(score, 6) AS score FROM p WHERE dist <= 35 QUALIFY row_number() OVER (PARTITION BY g, circle ORDER BY score, candidate) = 1
"""

QUERIES = {
    "circle_order": (circle_order, CIRCLE_ORDER),
    "leader_cluster": (leader_cluster, LEADER_CLUSTER),
    "nms_circles": (nms_circles, NMS_CIRCLES),
    "nms_temporal": (nms_temporal, NMS_TEMPORAL),
    "layout_select": (layout_select, LAYOUT_SELECT),
    "min_support": (min_support, MIN_SUPPORT),
    "consensus_shift": (consensus_shift, CONSENSUS_SHIFT),
    "track_centres": (track_centres, TRACK_CENTRES),
    "refine_radius": (refine_radius, REFINE_RADIUS),
    "stabilize_radii": (stabilize_radii, STABILIZE_RADII),
    "nearest_candidate": (nearest_candidate, NEAREST_CANDIDATE),
}
