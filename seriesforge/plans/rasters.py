"""Queries of the raster, graph and model operators, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import graph, metrics, raster
from seriesforge.plans.circles import greedy
from seriesforge.plans.common import r6, table

WIDTH, HEIGHT = 80, 25


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a pixel, 2,000 of them a frame: gray by its price, with dark sides and a bright disc."""
    k, px, py, f = F.col("o_orderkey"), F.col("px"), F.col("py"), F.col("frame")
    grid = table(spark, d, "orders").select(F.floor(k / (WIDTH * HEIGHT)).alias("frame"), (k % WIDTH).alias("px"), (F.floor(k / WIDTH) % HEIGHT).alias("py"), F.floor("o_totalprice").alias("price"))
    disc = F.when((px - 40) * (px - 40) + (py - 10) * (py - 10) <= 64, 80.0).otherwise(0.0)
    return grid.select("frame", "px", "py", F.when((px < 22) | (px >= 70 - f * 5 % 20), 5.0).otherwise(40.0 + disc + F.col("price") % 17).alias("gray"))


PLACES = ((0, 40.3, 10.2, 8.0), (1, 30.5, 4.5, 5.0), (2, 78.0, 24.0, 6.0), (3, 50.0, 12.0, 20.0))
PIXELS = f"""
px0 AS (SELECT o_orderkey // {WIDTH * HEIGHT} AS frame, o_orderkey % {WIDTH} AS px, o_orderkey // {WIDTH} % {HEIGHT} AS py, floor(o_totalprice)::BIGINT AS price FROM orders),
pix AS (SELECT frame, px, py, CASE WHEN px < 22 OR px >= 70 - frame * 5 % 20 THEN 5.0::DOUBLE ELSE 40.0::DOUBLE + (CASE WHEN (px - 40) * (px - 40) + (py - 10) * (py - 10) <= 64 THEN 80 ELSE 0 END) + price % 17 END AS gray FROM px0),
ci(circle, x, y, r) AS (SELECT c::BIGINT, x::DOUBLE, y::DOUBLE, r::DOUBLE FROM (VALUES {", ".join(map(str, PLACES))}) q(c, x, y, r))"""


def _circles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PLACES), "circle long, x double, y double, r double")


def max_projection(spark: SparkSession, d: str) -> DataFrame:
    return raster.max_projection(pixels(spark, d))


def disc_mean(spark: SparkSession, d: str) -> DataFrame:
    return raster.disc_means(pixels(spark, d), _circles(spark), WIDTH, HEIGHT).select("frame", "circle", *r6("value"))


DISC_MEAN = f"""WITH {PIXELS} SELECT frame, circle, round(avg(gray), 6) AS value FROM pix, ci
WHERE pow(px - round_even(x, 0), 2) + pow(py - round_even(y, 0), 2) <= pow(round_even(r, 0), 2) GROUP BY frame, circle"""


def patch_mean_9pt(spark: SparkSession, d: str) -> DataFrame:
    """Circles that drift by half a pixel a frame, three frames long, then start again."""
    p = pixels(spark, d)
    at = F.explode(F.array(*(F.struct(F.lit(c).cast("long").alias("circle"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(r).alias("r")) for c, x, y, r in PLACES)))
    circles = p.select("frame").distinct().select("frame", at.alias("c")).select("frame", "c.circle", (F.col("c.x") + F.col("frame") % 3 * 0.5).alias("x"), "c.y", "c.r")
    points = raster.sample_points(circles, ["frame", "circle"])
    return raster.patch_means(p, points, WIDTH, HEIGHT).select("frame", "circle", F.col("point").cast("long").alias("point"), *r6("value"))


PATCH_MEAN_9PT = f"""WITH {PIXELS},
fc AS (SELECT frame AS fr, circle, x + frame % 3 * 0.5::DOUBLE AS x, y, r FROM ci, (SELECT DISTINCT frame FROM pix)),
pt AS (SELECT fr, circle, 1::BIGINT AS point, x AS sx, y AS sy FROM fc UNION ALL SELECT fr, circle, k + 2, x + 0.6::DOUBLE * r * cos(radians(45.0::DOUBLE * k)), y + 0.6::DOUBLE * r * sin(radians(45.0::DOUBLE * k)) FROM fc, range(8) q(k)),
s AS (SELECT *, round_even(round(sx, 9), 0) AS ix, round_even(round(sy, 9), 0) AS iy FROM pt)
SELECT fr AS frame, circle, point, round(coalesce(avg(gray), 0), 6) AS value FROM s LEFT JOIN pix ON frame = fr AND px BETWEEN ix - 2 AND ix + 2 AND py BETWEEN iy - 2 AND iy + 2 GROUP BY ALL"""


def window_mean(spark: SparkSession, d: str) -> DataFrame:
    return raster.window_means(pixels(spark, d), _circles(spark), WIDTH, HEIGHT).select("frame", "circle", *r6("value"))


WINDOW_MEAN = f"""WITH {PIXELS}, w AS (SELECT *, greatest(8, round_even(r * 0.25::DOUBLE, 0)) AS h, round_even(x, 0) AS ix, round_even(y, 0) AS iy FROM ci)
SELECT frame, circle, round(avg(gray), 6) AS value FROM pix, w WHERE px BETWEEN ix - h AND ix + h AND py BETWEEN iy - h AND iy + h GROUP BY frame, circle"""


def pooled_mean(spark: SparkSession, d: str) -> DataFrame:
    return raster.pooled_mean(pixels(spark, d), _circles(spark), WIDTH, HEIGHT).select("frame", *r6("value"), "n")


POOLED_MEAN = f"WITH {PIXELS} SELECT frame, round(avg(gray), 6) AS value, count(*) AS n FROM pix, ci WHERE pow(px - x, 2) + pow(py - y, 2) < r * r GROUP BY frame"


def circle_evidence(spark: SparkSession, d: str) -> DataFrame:
    return raster.circle_evidence(pixels(spark, d), _circles(spark), WIDTH, HEIGHT).select("frame", "circle", *r6("score"))


CIRCLE_EVIDENCE = f"""WITH {PIXELS},
dd AS (SELECT frame, circle, gray, sqrt(pow(px - x, 2) + pow(py - y, 2)) AS far, r FROM pix, ci),
lv AS (SELECT frame, circle, avg(gray) FILTER (WHERE far <= r * 0.75::DOUBLE) AS a, avg(gray) FILTER (WHERE far >= r * 1.05::DOUBLE AND far <= r * 1.35::DOUBLE) AS b FROM dd GROUP BY 1, 2),
an AS (SELECT circle, i * (2 * 3.141592653589793::DOUBLE / 64) AS t, x, y, r FROM ci, range(64) q(i)),
eg AS (SELECT circle, round_even(round(x + cos(t) * r * 0.82::DOUBLE, 9), 0) AS ax, round_even(round(y + sin(t) * r * 0.82::DOUBLE, 9), 0) AS ay, round_even(round(x + cos(t) * r * 1.12::DOUBLE, 9), 0) AS bx, round_even(round(y + sin(t) * r * 1.12::DOUBLE, 9), 0) AS bz FROM an),
sh AS (SELECT p.frame, circle, avg((p.gray - q.gray > 8)::INT) AS s FROM eg JOIN pix p ON p.px = ax AND p.py = ay JOIN pix q ON q.frame = p.frame AND q.px = bx AND q.py = bz GROUP BY 1, 2)
SELECT lv.frame, lv.circle, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE a - b + 40 * coalesce(s, 0) END, 6) AS score FROM lv LEFT JOIN sh ON sh.frame = lv.frame AND sh.circle = lv.circle
"""


def black_bars(spark: SparkSession, d: str) -> DataFrame:
    return raster.black_bars(pixels(spark, d))


BLACK_BARS = f"""WITH {PIXELS}, m AS (SELECT frame, px, avg(gray) AS g FROM pix GROUP BY 1, 2),
e AS (SELECT frame, coalesce(min(px) FILTER (WHERE g >= 25), max(px) + 1) AS l, coalesce(max(px) - max(px) FILTER (WHERE g >= 25), max(px) + 1) AS r FROM m GROUP BY 1)
SELECT frame, CASE WHEN l < 20 THEN 0 ELSE l END AS "left", CASE WHEN r < 20 THEN 0 ELSE r END AS "right" FROM e"""


def mask_shape(spark: SparkSession, d: str) -> DataFrame:
    """Bright pixels as the mask, their middle row as the spine; every third frame has no spine."""
    mask = pixels(spark, d).where("gray > 100")
    return raster.mask_shape(mask, mask.where("py = 10 and frame % 3 <> 2")).select("frame", "area", "length", *r6("thickness"))


MASK_SHAPE = f"""WITH {PIXELS}, m AS (SELECT frame, count(*) AS area, count(*) FILTER (WHERE py = 10 AND frame % 3 <> 2) AS length FROM pix WHERE gray > 100 GROUP BY frame)
SELECT frame, area, length, round(coalesce(area / nullif(length, 0)::DOUBLE, 0), 6) AS thickness FROM m"""


def unboxed(spark: SparkSession, d: str) -> DataFrame:
    out = raster.unboxed(pixels(spark, d).where("gray > 100").select("frame", "px", "py"), F.lit(0.5), F.lit(10), F.lit(4), F.lit(22))
    return out.select("frame", "px", "py")


UNBOXED = f"WITH {PIXELS} SELECT DISTINCT frame, floor((px - 10 + 0.5::DOUBLE) / 0.5::DOUBLE)::BIGINT + 22 AS px, floor((py - 4 + 0.5::DOUBLE) / 0.5::DOUBLE)::BIGINT AS py FROM pix WHERE gray > 100"


def _speckles(spark: SparkSession, d: str) -> DataFrame:
    """Frames of 16 x 16 places, an event each; those of two kinds are bright."""
    i = F.col("event_id")
    rows = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    return rows.select(F.floor(i / 256).alias("frame"), (i % 16).alias("px"), (F.floor(i / 16) % 16).alias("py"))


SPECKLES = """sp AS (SELECT frame, px, py, frame * 1099511627776 + py * 1048576 + px AS id FROM
  (SELECT event_id // 256 AS frame, event_id % 16 AS px, event_id // 16 % 16 AS py FROM events WHERE event_type IN ('click', 'view')))"""


def components_area(spark: SparkSession, d: str) -> DataFrame:
    return graph.large_components(_speckles(spark, d), "frame", 3)


COMPONENTS_AREA = f"""WITH RECURSIVE {SPECKLES},
e AS (SELECT a.id AS a, b.id AS b FROM sp a JOIN sp b ON a.frame = b.frame AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1),
re(a, b) AS (SELECT id, id FROM sp UNION SELECT re.a, e.b FROM re JOIN e ON e.a = re.b),
l AS (SELECT a, min(b) AS component FROM re GROUP BY a)
SELECT frame, component, count(*) AS area FROM sp JOIN l ON l.a = sp.id GROUP BY 1, 2 HAVING count(*) >= 3
"""


def _trees(spark: SparkSession, d: str) -> DataFrame:
    """A Y-shaped tree of pixels for every customer, its arms as long as the customer's nation says."""
    at = lambda x, y: F.struct(x.alias("px"), y.alias("py"))
    arm = lambda low, high, f: F.transform(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long") if isinstance(high, int) else high), f)
    nation = F.col("c_nationkey").cast("long")
    pixels = F.concat(
        arm(0, 6, lambda k: at(F.lit(40).cast("long"), k)), arm(1, 1 + nation % 7, lambda k: at(40 - k, 6 + k)), arm(1, 2 + nation, lambda k: at(40 + k, 6 + k))
    )
    return table(spark, d, "customer").select(F.col("c_custkey").alias("frame"), F.explode(pixels).alias("p")).select("frame", "p.px", "p.py")


def longest_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.longest_path(_trees(spark, d), "frame").select("frame", F.col("step").cast("long").alias("step"), "id")


LONGEST_PATH = """WITH RECURSIVE tr AS (
  SELECT c_custkey AS frame, 40::BIGINT AS px, k AS py FROM customer, range(7) b(k) UNION ALL SELECT c_custkey, 40 - k, 6 + k FROM customer, range(1, 8) b(k) WHERE k <= 1 + c_nationkey % 7
  UNION ALL SELECT c_custkey, 40 + k, 6 + k FROM customer, range(1, 27) b(k) WHERE k <= 2 + c_nationkey),
n AS (SELECT frame, px, py, frame * 1099511627776 + py * 1048576 + px AS id FROM tr),
e AS (SELECT a.frame, a.id AS a, b.id AS b FROM n a JOIN n b ON a.frame = b.frame AND a.id <> b.id AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1),
s AS (SELECT frame, min(a) AS id FROM (SELECT frame, a FROM e GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1),
w1(frame, id, up, l) AS (SELECT frame, id, -1::BIGINT, 0 FROM s UNION ALL SELECT e.frame, e.b, e.a, l + 1 FROM w1 JOIN e ON e.a = w1.id AND e.b <> w1.up),
fa AS (SELECT frame, id FROM w1 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY l DESC, id) = 1),
w2(frame, id, up, l) AS (SELECT frame, id, -1::BIGINT, 0 FROM fa UNION ALL SELECT e.frame, e.b, e.a, l + 1 FROM w2 JOIN e ON e.a = w2.id AND e.b <> w2.up),
fb AS (SELECT frame, id, l AS far FROM w2 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY l DESC, id) = 1),
w3(frame, id, up, l) AS (SELECT frame, id, -1::BIGINT, 0 FROM fb UNION ALL SELECT e.frame, e.b, e.a, l + 1 FROM w3 JOIN e ON e.a = w3.id AND e.b <> w3.up)
SELECT w2.frame, w2.l::BIGINT AS step, w2.id FROM w2 JOIN w3 ON w3.id = w2.id JOIN fb ON fb.frame = w2.frame WHERE w2.l + w3.l = fb.far
"""

#: Shapes nearer than this count as seen before.
NEAR = 0.13
_ERROR = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))) / 64"


def unique_shapes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.unique_in_order(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", NEAR)


UNIQUE_SHAPES = f"""WITH RECURSIVE v AS (SELECT label AS g, vec_id AS id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rk FROM embeddings), {greedy("v", _ERROR + f" <= {NEAR}::DOUBLE")}
SELECT g AS label, id AS vec_id FROM ke"""


def unique_shapes_mis(spark: SparkSession, d: str) -> DataFrame:
    return metrics.unique_in_order(table(spark, d, "embeddings"), [], "vec_id", "embedding", NEAR)


UNIQUE_SHAPES_MIS = f"""WITH RECURSIVE v AS (SELECT 0 AS g, vec_id AS id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) AS rk FROM embeddings), {greedy("v", _ERROR + f" <= {NEAR}::DOUBLE")}
SELECT id AS vec_id FROM ke"""


def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    a = l.select(F.lit("price").alias("output"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0 + 1000.0).alias("p"))
    b = l.select(F.lit("tax").alias("output"), F.col("l_tax").alias("y"), (F.col("l_discount") * 0.5 + 0.01).alias("p"))
    return metrics.regression_metrics(a.unionByName(b), "output").select(*r6("r2"), *(F.round(c, 4).alias(c) for c in ("mae", "rmse")))


REGRESSION_METRICS = """
WITH r AS (SELECT 'price' AS o, l_extendedprice AS y, l_quantity * 1500.0::DOUBLE + 1000.0::DOUBLE AS p FROM lineitem UNION ALL SELECT 'tax', l_tax, l_discount * 0.5::DOUBLE + 0.01::DOUBLE FROM lineitem),
m AS (SELECT o, avg(y) AS m FROM r GROUP BY 1),
s AS (SELECT o, sum(pow(y - p, 2)) AS sse, sum(pow(y - m, 2)) AS sst, sum(abs(y - p)) AS sae, count(*) AS n FROM r JOIN m USING (o) GROUP BY 1)
SELECT round(avg(1 - sse / sst), 6) AS r2, round(sum(sae) / sum(n), 4) AS mae, round(sqrt(avg(sse / n)), 4) AS rmse FROM s
"""


def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.principal_components(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return out.select("vec_id", F.get("pc", F.lit(0)).alias("pc1"), F.get("pc", F.lit(1)).alias("pc2"))


def forest_regressor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("label", F.col("label").cast("double"))
    return metrics.forest_predictions(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "embedding", ["label"]).select("vec_id", "label", "label_predicted")


def forest_multi_output(spark: SparkSession, d: str) -> DataFrame:
    """The last four elements of every fifth vector, from the others, by one forest."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 60).alias("x"), *(F.get("embedding", F.lit(60 + i)).cast("double").alias(f"t{i}") for i in range(4)))
    return metrics.forest_predictions(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "x", [f"t{i}" for i in range(4)]).drop("x")


QUERIES = {
    "max_projection": (max_projection, f"WITH {PIXELS} SELECT px, py, max(gray) AS gray, count(DISTINCT frame) AS frames FROM pix GROUP BY 1, 2"),
    "disc_mean": (disc_mean, DISC_MEAN),
    "patch_mean_9pt": (patch_mean_9pt, PATCH_MEAN_9PT),
    "window_mean": (window_mean, WINDOW_MEAN),
    "pooled_mean": (pooled_mean, POOLED_MEAN),
    "circle_evidence": (circle_evidence, CIRCLE_EVIDENCE),
    "black_bars": (black_bars, BLACK_BARS),
    "mask_shape": (mask_shape, MASK_SHAPE),
    "unboxed": (unboxed, UNBOXED),
    "components_area": (components_area, COMPONENTS_AREA),
    "longest_path": (longest_path, LONGEST_PATH),
    "unique_shapes": (unique_shapes, UNIQUE_SHAPES),
    "unique_shapes_mis": (unique_shapes_mis, UNIQUE_SHAPES_MIS),
    "regression_metrics": (regression_metrics, REGRESSION_METRICS),
    "pca_2d": (pca_2d, None),
    "forest_regressor": (forest_regressor, None),
    "forest_multi_output": (forest_multi_output, None),
}
