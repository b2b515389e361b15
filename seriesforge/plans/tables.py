"""Queries of the table operators, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.ranking import positioned
from seriesforge.functions.scalar import finite_int, letterbox, radius_bounds
from seriesforge.operators import tables as t
from seriesforge.plans.common import r6, table
from seriesforge.sources import files


def parse_spine_text(spark: SparkSession, d: str) -> DataFrame:
    """Curves as text, in both forms and in broken ones, from the lines of orders."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), (F.col("l_partkey") + 1).alias("p")))).alias("a"))
    new = F.concat(F.lit("["), F.array_join(F.transform("a", lambda s: F.concat(F.lit("("), s["q"], F.lit(", "), s["p"], F.lit(")"))), ", "), F.lit("]"))
    old = F.array_join(F.transform("a", lambda s: F.concat(F.lit("np.int64("), s["q"], F.lit("), np.int64(-"), s["p"], F.lit(")"))), ", ")
    kind = F.col("l_orderkey") % 4
    text = F.when(kind == 0, new).when(kind == 1, old).when(kind == 2, F.lit("[[1,2]] free text"))
    return t.parsed_spines(rows.select("l_orderkey", text.alias("text")), ["l_orderkey"], "text").select("l_orderkey", F.col("point").cast("long").alias("point"), "x", "y")


PARSE_SPINE_TEXT = """
WITH a AS (SELECT l_orderkey, l_quantity::INT AS q, l_partkey + 1 AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::INT, l_partkey) - 1 AS point FROM lineitem)
SELECT l_orderkey, point, q::DOUBLE AS x, (CASE WHEN l_orderkey % 4 = 0 THEN p ELSE -p END)::DOUBLE AS y FROM a WHERE l_orderkey % 4 IN (0, 1)
"""


def coerce_frame_id(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 7 == 0, "NaN").when(F.col("event_id") % 7 == 1, "n/a").when(F.col("event_id") % 7 == 2, F.concat(k, F.lit(".9"))).otherwise(k)
    return table(spark, d, "events").select("event_id", finite_int(text).alias("frame_id")).where("frame_id is not null")


COERCE_FRAME_ID = """
WITH a AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events),
b AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'NaN' WHEN 1 THEN 'n/a' WHEN 2 THEN k || '.9' ELSE k END AS x FROM a)
SELECT event_id, trunc(try_cast(x AS DOUBLE))::BIGINT AS frame_id FROM b WHERE try_cast(x AS DOUBLE) IS NOT NULL AND isfinite(try_cast(x AS DOUBLE))
"""


def natural_column_order(spark: SparkSession, d: str) -> DataFrame:
    """Names of columns, as rows, in their natural order."""
    i = F.col("p_partkey")
    name = F.when(i % 5 == 0, F.concat(F.lit("intensity_circle_"), i % 40)).when(i % 5 == 4, F.concat(F.lit("circle_"), i, F.lit("_radius"))).otherwise(
        F.concat(F.lit("intensity_circle_"), i % 40, F.lit("_9pt_"), i % 9 + 1)
    )
    names = t.with_natural_order(table(spark, d, "part").select(name.alias("name")).distinct(), "name")
    ranked = positioned(names, ["circle", "point", "name"], "rank")
    return ranked.select("name", "circle", "point", (F.col("rank") + 1).alias("rank"))


NATURAL_COLUMN_ORDER = r"""
WITH a AS (SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN 'intensity_circle_' || (p_partkey % 40) WHEN p_partkey % 5 = 4 THEN 'circle_' || p_partkey || '_radius'
  ELSE 'intensity_circle_' || (p_partkey % 40) || '_9pt_' || (p_partkey % 9 + 1) END AS name FROM part),
b AS (SELECT name, CASE WHEN name LIKE 'intensity%' THEN regexp_extract(name, '(\d+)', 1)::BIGINT ELSE 1000000000 END AS circle,
  CASE WHEN name LIKE '%pt_%' THEN regexp_extract(name, '_9pt_(\d+)', 1)::BIGINT WHEN name LIKE 'intensity%' THEN 0 ELSE 1000000000 END AS point FROM a)
SELECT name, circle, point, row_number() OVER (ORDER BY circle, point, name) AS rank FROM b
"""


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """A wide intensity table: frames are event ids, columns of two circles."""
    e = table(spark, d, "events")
    cols = [F.col("event_id").alias("Frame_ID")]
    for c in (1, 0):
        cols.append((F.col("value") * (c + 1)).alias(f"intensity_circle_{c}"))
        cols += [(F.col("value") + 10 * c + p).alias(f"intensity_circle_{c}_9pt_{p}") for p in (2, 1, 3)]
        cols.append(F.lit(5.0 + c).alias(f"circle_{c}_radius"))
    return e.select(*cols)


def drop_pt_columns(spark: SparkSession, d: str) -> DataFrame:
    kept = t.without_points(_wide(spark, d))
    return kept.select(F.col("Frame_ID").alias("frame_id"), *[F.round(c, 6).alias(c) for c in kept.columns if c != "Frame_ID"])


DROP_PT_COLUMNS = """
SELECT event_id AS frame_id, round(value, 6) AS intensity_circle_0, round(value * 2, 6) AS intensity_circle_1, 5.0::DOUBLE AS circle_0_radius, 6.0::DOUBLE AS circle_1_radius FROM events
"""


def nine_point_average(spark: SparkSession, d: str) -> DataFrame:
    rows = t.long_intensities(_wide(spark, d)).where("point > 0")
    return rows.groupBy(F.col("Frame_ID").alias("frame_id"), "circle").agg(F.round(F.avg("value"), 6).alias("mean"))


NINE_POINT_AVERAGE = """
SELECT event_id AS frame_id, c AS circle, round(avg(value + 10 * c + p), 6) AS mean FROM events, (VALUES (0::BIGINT), (1)) AS k(c), (VALUES (1), (2), (3)) AS q(p) GROUP BY event_id, c
"""


def align_common_frames(spark: SparkSession, d: str) -> DataFrame:
    """Rows of documents, pages and vectors on the ids that labels, too, hold."""
    a = table(spark, d, "documents").select(F.col("doc_id").alias("frame"), F.lit("documents").alias("source"))
    b = table(spark, d, "pages").select(F.col("page_id").alias("frame"), F.lit("pages").alias("source"))
    c = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.lit("embeddings").alias("source"))
    e = table(spark, d, "labels").select(F.col("doc_id").alias("frame"), F.lit("labels").alias("source"))
    return t.concatenated(t.aligned([a, b, c, e], ["frame"]))


ALIGN_COMMON_FRAMES = """
WITH k AS (SELECT doc_id AS frame FROM documents INTERSECT SELECT page_id FROM pages INTERSECT SELECT vec_id FROM embeddings INTERSECT SELECT doc_id FROM labels)
SELECT doc_id AS frame, 'documents' AS source, 0 AS recording_ord FROM documents WHERE doc_id IN (SELECT frame FROM k)
UNION ALL SELECT page_id, 'pages', 1 FROM pages WHERE page_id IN (SELECT frame FROM k)
UNION ALL SELECT vec_id, 'embeddings', 2 FROM embeddings WHERE vec_id IN (SELECT frame FROM k)
UNION ALL SELECT doc_id, 'labels', 3 FROM labels WHERE doc_id IN (SELECT frame FROM k)
"""


def root_relative(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"), F.max("l_tax").alias("x"), F.max("l_discount").alias("s"))
    top = line.select("l_orderkey", F.col("l_linenumber").alias("point"), F.col("q").alias("x"), F.col("p").alias("y"))
    side = line.select("l_orderkey", F.col("l_linenumber").alias("point"), F.col("x"), F.col("s").alias("y")).where("point <> 6")
    return t.root_relative(top, side, ["l_orderkey"]).select("l_orderkey", "point", *r6("x", "top_y", "side_y"))


ROOT_RELATIVE = """
WITH l AS (SELECT l_orderkey, l_linenumber AS point, max(l_quantity) q, max(l_extendedprice) p, max(l_tax) tx, max(l_discount) s FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey, point, (q + tx) / 2 AS x, p, s FROM l WHERE point <> 6)
SELECT l_orderkey, point, round(x - first_value(x) OVER w, 6) AS x, round(p - first_value(p) OVER w, 6) AS top_y, round(s - first_value(s) OVER w, 6) AS side_y
FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY point)
"""


def verify_outputs(spark: SparkSession, d: str) -> DataFrame:
    o, l = table(spark, d, "orders").withColumnRenamed("o_orderkey", "k"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    l = l.withColumn("l_tax", F.when(F.col("l_tax") > 0.07, None).otherwise(F.col("l_tax")))
    return t.verified({"orders": o, "lineitem": l}, ["k"], {"orders": ["o_totalprice"], "lineitem": ["l_quantity", "l_tax"]})


VERIFY_OUTPUTS = """
WITH c AS (SELECT count(*) AS n_common FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)),
r AS (SELECT 'orders' AS name, count(*) AS n_rows, (count(*) - count(o_totalprice))::BIGINT AS n_nulls FROM orders
  UNION ALL SELECT 'lineitem', count(*), (count(*) - count(l_quantity) + count(*) - count(CASE WHEN l_tax > 0.07::DOUBLE THEN NULL ELSE l_tax END))::BIGINT FROM lineitem)
SELECT name, n_rows, n_nulls, n_common, n_nulls = 0 AND n_common > 60 AS passed FROM r, c
"""


def concat_recordings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), "value", "event_type")
    parts = [e.where(F.col("event_type") == k).drop("event_type" if k == "view" else "user_id") for k in ("view", "click", "purchase", "error", "signup")]
    return t.concatenated(parts).select("recording_ord", "event_id", "user_id", "value", "event_type")


CONCAT_RECORDINGS = """
SELECT CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS recording_ord, event_id, CASE WHEN event_type = 'view' THEN user_id::VARCHAR END AS user_id, value,
  CASE WHEN event_type <> 'view' THEN event_type END AS event_type FROM events
"""


def letterbox_geometry(spark: SparkSession, d: str) -> DataFrame:
    w, h = 100 + F.col("p_size") * 37, 80 + F.col("p_partkey") % 900
    boxes = letterbox(w, h)
    low, high = radius_bounds(w, h)
    return table(spark, d, "part").select("p_partkey", *(F.round(c, 6).alias(n) if n == "scale" else c.cast("long").alias(n) for n, c in boxes.items()), low.cast("long").alias("least_radius"), high.cast("long").alias("most_radius"))


LETTERBOX_GEOMETRY = """
WITH a AS (SELECT p_partkey, 100 + p_size * 37 AS w, 80 + p_partkey % 900 AS h FROM part),
b AS (SELECT *, least(1024.0::DOUBLE / w, 1024.0::DOUBLE / h) AS s FROM a),
c AS (SELECT *, round_even(w * s, 0)::BIGINT AS nw, round_even(h * s, 0)::BIGINT AS nh FROM b)
SELECT p_partkey, round(s, 6) AS scale, nw AS new_w, nh AS new_h, (1024 - nw) // 2 AS pad_left, (1024 - nh) // 2 AS pad_top, 1024 - nw - (1024 - nw) // 2 AS pad_right, 1024 - nh - (1024 - nh) // 2 AS pad_bottom,
  greatest(18, round_even(least(w, h) * 0.045::DOUBLE, 0)::BIGINT) AS least_radius,
  greatest(greatest(18, round_even(least(w, h) * 0.045::DOUBLE, 0)::BIGINT) + 8, round_even(least(w, h) * 0.11::DOUBLE, 0)::BIGINT) AS most_radius FROM c
"""


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.count("*") * 700 + F.min("o_orderkey") % 50).alias("total"))


def chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    return t.chunk_ranges(_frames(spark, d), "total", 2500).select("o_custkey", "total", "range_start", "range_end", "tag")


CHUNK_RANGES = """
WITH f AS (SELECT o_custkey, count(*) * 700 + min(o_orderkey) % 50 AS total FROM orders GROUP BY 1),
r AS (SELECT *, unnest(range(0, total, 2500)) AS range_start FROM f)
SELECT o_custkey, total, range_start, least(range_start + 2500, total) AS range_end, printf('__%06d-%06d', range_start, least(range_start + 2500, total) - 1) AS tag FROM r
"""


def missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Holes in completed chunks: every fifth is missing."""
    done = t.chunk_ranges(_frames(spark, d), "total", 2500).where((F.col("range_start") / 2500 + F.col("o_custkey")) % 5 != 0)
    return t.coverage_breaks(done, ["o_custkey"], "total")


MISSING_CHUNKS = """
WITH f AS (SELECT o_custkey, count(*) * 700 + min(o_orderkey) % 50 AS total FROM orders GROUP BY 1),
r AS (SELECT *, unnest(range(0, total, 2500)) AS s FROM f),
c AS (SELECT o_custkey, total, s, least(s + 2500, total) AS e FROM r WHERE (s // 2500 + o_custkey) % 5 <> 0),
g AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY o_custkey ORDER BY s), 0) AS x FROM c)
SELECT o_custkey, x AS expected, s AS found FROM g WHERE s <> x
UNION ALL SELECT o_custkey, max(e), max(total) FROM c GROUP BY o_custkey HAVING max(e) <> max(total)
"""


def chunk_completeness(spark: SparkSession, d: str) -> DataFrame:
    ranges = t.chunk_ranges(table(spark, d, "customer").select("c_custkey", F.lit(60).cast("long").alias("total")), "total", 25)
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 60).alias("frame"))
    return t.complete_chunks(ranges, done, ["c_custkey"], "frame").select("c_custkey", "range_start", "range_end", "found", "complete")


CHUNK_COMPLETENESS = """
WITH r AS (SELECT c_custkey, unnest(range(0, 60, 25)) AS range_start FROM customer),
q AS (SELECT *, least(range_start + 25, 60) AS range_end FROM r)
SELECT c_custkey, range_start, range_end, count(DISTINCT o_orderkey % 60) AS found, count(DISTINCT o_orderkey % 60) >= range_end - range_start AS complete
FROM q LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 60 >= range_start AND o_orderkey % 60 < range_end GROUP BY c_custkey, range_start, range_end
"""


def progress_json(spark: SparkSession, d: str) -> DataFrame:
    """State documents written as JSON and read again: completed ranges, without repeats."""
    spans = t.chunk_ranges(_frames(spark, d), "total", 2500)
    doc = spans.groupBy("o_custkey").agg(F.to_json(F.struct(F.lit("running").alias("status"), F.sort_array(F.collect_list(F.struct(F.col("range_start").alias("start"), F.col("range_end").alias("end")))).alias("completed_chunks"))).alias("doc"))
    doc = doc.withColumn("doc", F.when(F.col("o_custkey") % 11 == 0, F.lit("{broken")).otherwise(F.col("doc")))
    state = doc.withColumn("s", F.from_json("doc", "status string, completed_chunks array<struct<start:bigint,end:bigint>>"))
    return state.select("o_custkey", "s.status", F.explode(F.array_distinct("s.completed_chunks")).alias("c")).select("o_custkey", "status", "c.start", "c.end")


PROGRESS_JSON = """
WITH f AS (SELECT o_custkey, count(*) * 700 + min(o_orderkey) % 50 AS total FROM orders GROUP BY 1), r AS (SELECT *, unnest(range(0, total, 2500)) AS s FROM f)
SELECT o_custkey, 'running' AS status, s AS "start", least(s + 2500, total) AS "end" FROM r WHERE o_custkey % 11 <> 0
"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Video files named after pages."""
    i = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, (" Speckle", " LED", " Fib", " Side", " Top", " combined", "", " LED_segmented", "__000000-002499_segmented"))), (i % 9 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, (".mp4", ".MP4", ".mov", ".txt"))), (i % 4 + 1).cast("int"))
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    return table(spark, d, "pages").select(F.concat(F.lit("/data/"), host, F.lit("/"), F.lit("rec "), i % 50, kind, ext).alias("path"), (F.length("html") % 1000).cast("long").alias("size"), "page_id")


_PATHS_SQL = r"""
p AS (SELECT page_id, '/data/' || regexp_extract(url, '://([^/]+)', 1) || '/rec ' || (page_id % 50) || [' Speckle', ' LED', ' Fib', ' Side', ' Top', ' combined', '', ' LED_segmented', '__000000-002499_segmented'][page_id % 9 + 1]
  || ['.mp4', '.MP4', '.mov', '.txt'][page_id % 4 + 1] AS path, length(html) % 1000 AS size FROM pages),
n AS (SELECT *, lower(regexp_extract(path, '([^/]+)$', 1)) AS name FROM p)"""


def classify_videos(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d)
    a = files.intensity_videos(p).select("page_id", "path", F.lit("intensity").alias("use"), F.lit(0).cast("long").alias("rank"))
    b = files.segmentation_videos(p).select("page_id", "path", F.lit("segmentation").alias("use"), F.col("rank").cast("long").alias("rank"))
    return a.unionByName(b)


CLASSIFY_VIDEOS = rf"""
WITH {_PATHS_SQL}
SELECT page_id, path, 'intensity' AS use, 0::BIGINT AS rank FROM n WHERE name LIKE '%.mp4' AND regexp_matches(name, 'speckle|led|fib') AND NOT regexp_matches(name, 'side|top|combined|segmented')
UNION ALL SELECT page_id, path, 'segmentation', row_number() OVER (ORDER BY size, lower(path), path) FROM n WHERE regexp_matches(name, '\.(mp4|mov|avi|mkv)$') AND NOT regexp_matches(name, 'speckle|combined')
"""


def segmented_sources(spark: SparkSession, d: str) -> DataFrame:
    return files.segmented_sources(_paths(spark, d))


SEGMENTED_SOURCES = rf"""
WITH {_PATHS_SQL},
m AS (SELECT regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]+$', '') AS stem FROM n WHERE regexp_matches(name, '\.(mp4|mov|avi|mkv)$'))
SELECT DISTINCT CASE WHEN contains(stem, '__') THEN split_part(stem, '__', 1) ELSE regexp_replace(stem, '_segmented.*$', '') END AS source FROM m WHERE contains(stem, '_segmented')
"""


def first_existing_source(spark: SparkSession, d: str) -> DataFrame:
    """For each recording, the first of Fib, LED, Speckle files that exists."""
    there = _paths(spark, d).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    recordings = table(spark, d, "pages").select(F.concat(F.lit("rec "), F.col("page_id") % 60).alias("recording")).distinct()
    wanted = recordings.select("recording", F.posexplode(F.array(*map(F.lit, ("Fib", "LED", "Speckle")))).alias("priority", "kind"))
    wanted = wanted.select("recording", "priority", F.concat("recording", F.lit(" "), "kind", F.lit(".mp4")).alias("name"))
    return files.first_existing(wanted, there, ["recording"])


FIRST_EXISTING_SOURCE = rf"""
WITH {_PATHS_SQL},
w AS (SELECT 'rec ' || i AS recording, k AS priority, 'rec ' || i || ' ' || ['Fib', 'LED', 'Speckle'][k + 1] || '.mp4' AS name FROM (SELECT DISTINCT page_id % 60 AS i FROM pages), (VALUES (0), (1), (2)) b(k)),
e AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY priority) AS r FROM w WHERE name IN (SELECT regexp_extract(path, '([^/]+)$', 1) FROM p))
SELECT recording, name, priority FROM e WHERE r = 1
"""

QUERIES = {
    "parse_spine_text": (parse_spine_text, PARSE_SPINE_TEXT),
    "coerce_frame_id": (coerce_frame_id, COERCE_FRAME_ID),
    "natural_column_order": (natural_column_order, NATURAL_COLUMN_ORDER),
    "drop_pt_columns": (drop_pt_columns, DROP_PT_COLUMNS),
    "nine_point_average": (nine_point_average, NINE_POINT_AVERAGE),
    "align_common_frames": (align_common_frames, ALIGN_COMMON_FRAMES),
    "root_relative": (root_relative, ROOT_RELATIVE),
    "verify_outputs": (verify_outputs, VERIFY_OUTPUTS),
    "concat_recordings": (concat_recordings, CONCAT_RECORDINGS),
    "letterbox_geometry": (letterbox_geometry, LETTERBOX_GEOMETRY),
    "chunk_ranges": (chunk_ranges, CHUNK_RANGES),
    "missing_chunks": (missing_chunks, MISSING_CHUNKS),
    "chunk_completeness": (chunk_completeness, CHUNK_COMPLETENESS),
    "progress_json": (progress_json, PROGRESS_JSON),
    "classify_videos": (classify_videos, CLASSIFY_VIDEOS),
    "segmented_sources": (segmented_sources, SEGMENTED_SOURCES),
    "first_existing_source": (first_existing_source, FIRST_EXISTING_SOURCE),
}
