"""Queries of the filters on pixel tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import circles, graph, imaging
from seriesforge.plans.circles import DISTANCE, greedy
from seriesforge.plans.common import r6, table
from seriesforge.plans.rasters import HEIGHT, PIXELS, WIDTH, pixels

LOW, HIGH, VOTES, APART = 6, 11, 12, 9.0
LEAST_AREA = 10


def reflected(name: str, weights: tuple[int, ...], size: int) -> str:
    """A table (o, s, w): output o sums source s, mirrored at the borders, with weight w."""
    reach = len(weights) // 2
    values = ", ".join(f"({i - reach}, {w})" for i, w in enumerate(weights))
    return f"""{name}(o, s, w) AS (SELECT o, CASE WHEN o + k < 0 THEN -(o + k) WHEN o + k > {size - 1} THEN {2 * (size - 1)} - (o + k) ELSE o + k END, w FROM range({size}) q(o), (VALUES {values}) v(k, w))"""


def along_both(of: str, value: str, out: str, weights: tuple[int, ...]) -> str:
    """Weighted sums along both axes of a table (frame, px, py, value)."""
    return f"""{reflected(out + "_wx", weights, WIDTH)}, {reflected(out + "_wy", weights, HEIGHT)},
{out}_x AS (SELECT frame, o AS px, py, sum(w * {value})::BIGINT AS v FROM {of} JOIN {out}_wx ON s = px GROUP BY ALL),
{out} AS (SELECT frame, px, o AS py, sum(w * v)::BIGINT AS v FROM {out}_x JOIN {out}_wy ON s = py GROUP BY ALL)"""


SQUARE = imaging.UNIT * imaging.UNIT
BLUR = f"""{PIXELS}, {along_both("pix", "round(gray)::BIGINT", "b2", imaging.gaussian(2.0, 4))},
bl AS (SELECT frame, px, py, (v + {SQUARE // 2}) // {SQUARE} AS gray FROM b2)"""
EDGES = f"""{BLUR}, {reflected("dx", imaging.DIFFERENCE, WIDTH)}, {reflected("sx", imaging.SMOOTHING, WIDTH)}, {reflected("dy", imaging.DIFFERENCE, HEIGHT)}, {reflected("sy", imaging.SMOOTHING, HEIGHT)},
gd AS (SELECT frame, o AS px, py, sum(w * gray) AS v FROM bl JOIN dx ON s = px GROUP BY ALL), gs AS (SELECT frame, o AS px, py, sum(w * gray) AS v FROM bl JOIN sx ON s = px GROUP BY ALL),
gx AS (SELECT frame, px, o AS py, sum(w * v)::BIGINT AS gx FROM gd JOIN sy ON s = py GROUP BY ALL), gy AS (SELECT frame, px, o AS py, sum(w * v)::BIGINT AS gy FROM gs JOIN dy ON s = py GROUP BY ALL),
ed AS (SELECT frame, px, py, gx, gy, sqrt((gx * gx + gy * gy)::DOUBLE) AS norm FROM gx JOIN gy USING (frame, px, py) WHERE abs(gx) + abs(gy) >= 45)"""
VOTED = f"""{EDGES},
vp AS (SELECT frame, px + (r * gx) / norm AS x, py + (r * gy) / norm AS y FROM ed, (SELECT unnest(range({LOW}, {HIGH + 1})) AS r UNION ALL SELECT -unnest(range({LOW}, {HIGH + 1}))) q),
vo AS (SELECT frame, floor(x / 1.2::DOUBLE)::BIGINT AS cx, floor(y / 1.2::DOUBLE)::BIGINT AS cy, count(*) AS votes FROM vp WHERE x >= 0 AND x < {WIDTH} AND y >= 0 AND y < {HEIGHT} GROUP BY ALL)"""


def blurred_frames(spark: SparkSession, d: str) -> DataFrame:
    return imaging.blurred(pixels(spark, d), WIDTH, HEIGHT)


def circle_votes(spark: SparkSession, d: str) -> DataFrame:
    return imaging.votes(imaging.edges(imaging.blurred(pixels(spark, d), WIDTH, HEIGHT), WIDTH, HEIGHT), WIDTH, HEIGHT, LOW, HIGH)


def detected_circles(spark: SparkSession, d: str) -> DataFrame:
    return imaging.found_circles(pixels(spark, d), WIDTH, HEIGHT, LOW, HIGH, VOTES, APART).select("frame", *r6("x", "y", "r"), "votes")


DETECTED = f"""{VOTED},
nb AS (SELECT a.frame, a.cx, a.cy, a.votes FROM vo a
  LEFT JOIN vo l ON l.frame = a.frame AND l.cx = a.cx - 1 AND l.cy = a.cy LEFT JOIN vo u ON u.frame = a.frame AND u.cx = a.cx AND u.cy = a.cy - 1
  LEFT JOIN vo r ON r.frame = a.frame AND r.cx = a.cx + 1 AND r.cy = a.cy LEFT JOIN vo b ON b.frame = a.frame AND b.cx = a.cx AND b.cy = a.cy + 1
  WHERE a.votes >= {VOTES} AND a.votes > coalesce(l.votes, 0) AND a.votes > coalesce(u.votes, 0) AND a.votes >= coalesce(r.votes, 0) AND a.votes >= coalesce(b.votes, 0)),
pk AS (SELECT frame AS g, cy * {int(WIDTH / 1.2) + 1} + cx AS id, (cx + 0.5::DOUBLE) * 1.2::DOUBLE AS x, (cy + 0.5::DOUBLE) * 1.2::DOUBLE AS y, 0::DOUBLE AS r, votes FROM nb),
v AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY votes DESC, id) AS rk FROM pk), {greedy("v", DISTANCE + f" < {APART}::DOUBLE")},
kc AS (SELECT v.g AS frame, v.id, v.x, v.y, v.votes FROM ke JOIN v USING (g, id)),
rg AS (SELECT kc.frame, id, x, y, votes, floor(sqrt(pow(px - x, 2) + pow(py - y, 2)) + 0.5::DOUBLE)::BIGINT AS r, count(*) AS n FROM kc JOIN ed ON ed.frame = kc.frame GROUP BY ALL),
dt AS (SELECT frame, x, y, r, votes FROM rg WHERE r BETWEEN {LOW} AND {HIGH} QUALIFY row_number() OVER (PARTITION BY frame, id ORDER BY n / r DESC, r) = 1)"""
DETECTED_CIRCLES = f"WITH RECURSIVE {DETECTED} SELECT frame, round(x, 6) AS x, round(y, 6) AS y, round(r, 6)::DOUBLE AS r, votes FROM dt"


def clustered_detections(spark: SparkSession, d: str) -> DataFrame:
    """Circles of every frame, clustered over the frames of a recording of ten."""
    found = imaging.found_circles(pixels(spark, d), WIDTH, HEIGHT, LOW, HIGH, VOTES, APART)
    order = F.struct("frame", -F.col("votes"), "y", "x").alias("order")
    out = circles.leader_clusters(found.withColumn("recording", F.floor(F.col("frame") / 10)).withColumn("order", order), ["recording"], "order", 6.0, 3.0)
    return out.select("recording", "cluster", *r6("x", "y", "r"), "n", "support")


CLUSTERED = f"""WITH RECURSIVE {DETECTED},
n AS (SELECT frame // 10 AS g, frame, x, y, r::DOUBLE AS r, row_number() OVER (PARTITION BY frame // 10 ORDER BY frame, votes DESC, y, x) AS i FROM dt),
st(g, i, cl) AS (SELECT DISTINCT g, 0::BIGINT, []::STRUCT(n BIGINT, x DOUBLE, y DOUBLE, r DOUBLE, f BIGINT[])[] FROM n
  UNION ALL SELECT g, i, CASE WHEN m IS NULL THEN list_append(cl, {{'n': 1::BIGINT, 'x': x, 'y': y, 'r': r, 'f': [frame]}})
    ELSE list_transform(cl, lambda k, j: CASE WHEN j = m THEN {{'n': k.n + 1, 'x': k.x + x, 'y': k.y + y, 'r': k.r + r, 'f': list_distinct(list_append(k.f, frame))}} ELSE k END) END
  FROM (SELECT n.g, n.i, n.x, n.y, n.r, n.frame, st.cl, list_filter(range(1, len(st.cl) + 1), lambda j: sqrt(pow(n.x - st.cl[j].x / st.cl[j].n, 2) + pow(n.y - st.cl[j].y / st.cl[j].n, 2)) <= 6 AND abs(n.r - st.cl[j].r / st.cl[j].n) <= 3)[1] AS m
    FROM st JOIN n ON n.g = st.g AND n.i = st.i + 1)),
e AS (SELECT g, cl FROM st QUALIFY i = max(i) OVER (PARTITION BY g)),
k AS (SELECT g, unnest(range(len(cl))) AS cluster, cl FROM e)
SELECT g AS recording, cluster, round(cl[cluster + 1].x / cl[cluster + 1].n, 6) AS x, round(cl[cluster + 1].y / cl[cluster + 1].n, 6) AS y, round(cl[cluster + 1].r / cl[cluster + 1].n, 6) AS r, cl[cluster + 1].n AS n, len(cl[cluster + 1].f) AS support FROM k"""


def equalised_frames(spark: SparkSession, d: str) -> DataFrame:
    return imaging.equalised(pixels(spark, d), WIDTH, HEIGHT)


TW, TH = -(-WIDTH // 8), -(-HEIGHT // 8)
AREA = TW * TH
MOST = max(1, int(3.0 * AREA / 256))
EQUALISED = f"""WITH {PIXELS},
g AS (SELECT frame, px, py, greatest(0, least(255, round(gray)))::BIGINT AS gray FROM pix),
ex AS (SELECT frame, gray, unnest(CASE WHEN {2 * (WIDTH - 1)} - px BETWEEN {WIDTH} AND {TW * 8 - 1} THEN [px, {2 * (WIDTH - 1)} - px] ELSE [px] END) AS x, py FROM g),
ey AS (SELECT frame, gray, x, unnest(CASE WHEN {2 * (HEIGHT - 1)} - py BETWEEN {HEIGHT} AND {TH * 8 - 1} THEN [py, {2 * (HEIGHT - 1)} - py] ELSE [py] END) AS y FROM ex),
hi AS (SELECT frame, x // {TW} AS tx, y // {TH} AS ty, gray, count(*) AS n FROM ey GROUP BY ALL),
ov AS (SELECT frame, tx, ty, sum(greatest(n - {MOST}, 0))::BIGINT AS over FROM hi GROUP BY ALL),
bi AS (SELECT ov.*, i AS gray, least(coalesce(n, 0), {MOST}) + over // 256 + CASE WHEN i % greatest(256 // greatest(over % 256, 1), 1) = 0 AND i // greatest(256 // greatest(over % 256, 1), 1) < over % 256 THEN 1 ELSE 0 END AS n
  FROM ov CROSS JOIN range(256) q(i) LEFT JOIN hi ON hi.frame = ov.frame AND hi.tx = ov.tx AND hi.ty = ov.ty AND hi.gray = i),
lu AS (SELECT frame, tx, ty, gray, least(255, (2 * sum(n) OVER (PARTITION BY frame, tx, ty ORDER BY gray) * 255 + {AREA}) // {2 * AREA}) AS m FROM bi),
sx AS (SELECT frame, px, py, gray, floor((2 * px - {TW}) / {2 * TW}::DOUBLE)::BIGINT AS fx, floor((2 * py - {TH}) / {2 * TH}::DOUBLE)::BIGINT AS fy FROM g),
co AS (SELECT frame, px, py, gray, greatest(0, least(7, fx + i)) AS tx, greatest(0, least(7, fy + j)) AS ty,
  CASE WHEN i = 1 THEN 2 * px - {TW} - fx * {2 * TW} ELSE {2 * TW} - (2 * px - {TW} - fx * {2 * TW}) END * CASE WHEN j = 1 THEN 2 * py - {TH} - fy * {2 * TH} ELSE {2 * TH} - (2 * py - {TH} - fy * {2 * TH}) END AS w FROM sx, range(2) a(i), range(2) b(j))
SELECT frame, px, py, (sum(w * m)::BIGINT + {2 * AREA}) // {4 * AREA} AS gray FROM co JOIN lu USING (frame, tx, ty, gray) GROUP BY frame, px, py"""


def _mask(spark: SparkSession, d: str) -> DataFrame:
    """A disc and a bar in every frame, with holes, amid speckles, where prices say so."""
    k, px, py = F.col("o_orderkey"), F.col("px"), F.col("py")
    grid = table(spark, d, "orders").select(F.floor(k / (WIDTH * HEIGHT)).alias("frame"), (k % WIDTH).alias("px"), (F.floor(k / WIDTH) % HEIGHT).alias("py"), F.floor("o_totalprice").alias("price"))
    shape = ((px - 20) * (px - 20) + (py - 10) * (py - 10) <= 64) | (px.between(34, 74) & py.between(9, 14 + F.col("frame") % 3))
    return grid.where((shape & (F.col("price") % 11 != 0)) | (F.col("price") % 23 == 0)).select("frame", "px", "py")


MASK = f"""mp AS (SELECT o_orderkey // {WIDTH * HEIGHT} AS frame, o_orderkey % {WIDTH} AS px, o_orderkey // {WIDTH} % {HEIGHT} AS py, floor(o_totalprice)::BIGINT AS price FROM orders),
mk AS (SELECT frame, px, py, frame * 1099511627776 + py * 1048576 + px AS id FROM mp
  WHERE (((px - 20) * (px - 20) + (py - 10) * (py - 10) <= 64 OR px BETWEEN 34 AND 74 AND py BETWEEN 9 AND 14 + frame % 3) AND price % 11 <> 0) OR price % 23 = 0),
me AS (SELECT a.id AS a, b.id AS b FROM mk a JOIN mk b ON a.frame = b.frame AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1),
re(a, b) AS (SELECT id, id FROM mk UNION SELECT re.a, me.b FROM re JOIN me ON me.a = re.b),
lb AS (SELECT a, count(*) AS area FROM re GROUP BY a),
mc AS (SELECT frame, px, py, 1 AS one FROM mk JOIN lb ON lb.a = mk.id WHERE area >= {LEAST_AREA})"""
CLEANED = f"""{MASK}, {along_both("mc", "one", "mb", imaging.gaussian(3.0, 12))},
cm AS (SELECT frame, px, py FROM mb WHERE v * 2 > {SQUARE})"""


def mask_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return imaging.cleaned_mask(_mask(spark, d), WIDTH, HEIGHT, LEAST_AREA)


def mask_thinning(spark: SparkSession, d: str) -> DataFrame:
    return imaging.thinned(imaging.cleaned_mask(_mask(spark, d), WIDTH, HEIGHT, LEAST_AREA))


def _goes(second: bool) -> str:
    return "[" + ", ".join(str(code) for code in range(256) if imaging.may_go(code, second)) + "]"


BIT = "CASE " + " ".join(f"WHEN b.px = a.px + {i} AND b.py = a.py + {j} THEN {1 << bit}".replace("+ -", "- ") for bit, (i, j) in enumerate(imaging.RING)) + " ELSE 0 END"
#: Half rounds enough for masks of 40 pixels' thickness; frames of the stand-in are 25 pixels high.
HALVES = 40
THINNED = f"""{CLEANED},
th(i, frame, px, py) AS (SELECT 0, frame, px, py FROM cm
  UNION ALL SELECT i + 1, frame, px, py FROM (SELECT a.i, a.frame, a.px, a.py, coalesce(sum({BIT}), 0) AS code FROM th a LEFT JOIN th b ON b.frame = a.frame AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 GROUP BY ALL)
    WHERE i < {HALVES} AND NOT list_contains(CASE WHEN i % 2 = 0 THEN {_goes(False)} ELSE {_goes(True)} END, code))"""


def mask_spines(spark: SparkSession, d: str) -> DataFrame:
    """The longest way through each frame's thinned mask."""
    return graph.longest_path(mask_thinning(spark, d), "frame").select("frame", F.col("step").cast("long").alias("step"), "id")


QUERIES = {
    "blurred_frames": (blurred_frames, f"WITH {BLUR} SELECT * FROM bl"),
    "circle_votes": (circle_votes, f"WITH {VOTED} SELECT * FROM vo"),
    "detected_circles": (detected_circles, DETECTED_CIRCLES),
    "clustered_detections": (clustered_detections, CLUSTERED),
    "equalised_frames": (equalised_frames, EQUALISED),
    "mask_cleanup": (mask_cleanup, f"WITH RECURSIVE {CLEANED} SELECT * FROM cm"),
    "mask_thinning": (mask_thinning, f"WITH RECURSIVE {THINNED} SELECT frame, px, py FROM th WHERE i = {HALVES}"),
    "mask_spines": (mask_spines, None),
}
