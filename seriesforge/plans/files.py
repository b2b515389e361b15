"""Queries of scans, sinks, names and small predicates, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.scalar import crop_window, is_mask, small_jump
from seriesforge.functions.staging import new_path
from seriesforge.operators import series, tables
from seriesforge.plans.common import ORDER_OF_LINES, order_polylines, r6, table
from seriesforge.plans.tables import _PATHS_SQL, _paths
from seriesforge.sources import files

KINDS = ["click", "error", "purchase", "signup", "view"]


def read_spine_csv(spark: SparkSession, d: str) -> DataFrame:
    """A curve table written as CSV and read with its schema."""
    line = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), F.round(F.avg("l_quantity"), 3).alias("mean"), line.alias("a"))
    text = F.concat(F.lit("["), F.array_join(F.transform("a", lambda s: F.concat(F.lit("("), s["q"].cast("string"), F.lit(", "), s["l_linenumber"].cast("string"), F.lit(")"))), ", "), F.lit("]"))
    path = new_path(spark)
    files.write_csv(rows.select(F.col("l_orderkey").alias("Frame_ID"), F.col("n").alias("Length_px"), F.col("mean").alias("Avg_Thickness_px"), text.alias("Spine_Coords")), path)
    return files.read_spines(spark, path).select("Frame_ID", "Length_px", "Avg_Thickness_px", "Spine_Coords")


READ_SPINE_CSV = """
SELECT l_orderkey::VARCHAR AS "Frame_ID", count(*)::INT AS "Length_px", round(avg(l_quantity), 3) AS "Avg_Thickness_px",
  '[' || string_agg('(' || l_quantity::INT || ', ' || l_linenumber || ')', ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INT) || ']' AS "Spine_Coords" FROM lineitem GROUP BY l_orderkey
"""


def write_wide_csv(spark: SparkSession, d: str) -> DataFrame:
    """A long table made wide, written as CSV and read with the types found in it."""
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 3).alias("v"))
    path = new_path(spark)
    files.write_csv(files.pivoted(rows, ["user_id"], "event_type", "v", KINDS), path)
    return files.read_wide(spark, path).select(F.col("user_id").cast("long").alias("user_id"), *(F.col(k).cast("double").alias(k) for k in KINDS))


WRITE_WIDE_CSV = f"SELECT user_id, {', '.join(f'''round(sum(value) FILTER (WHERE event_type = '{k}'), 3) AS {k}''' for k in KINDS)} FROM events GROUP BY user_id"


def json_states(spark: SparkSession, d: str) -> DataFrame:
    """State documents, one a file, read tolerantly: a corrupt one gives nulls."""
    doc = F.to_json(F.struct(F.col("n_name").alias("base_name"), F.col("n_nationkey").alias("completed_until_frame")))
    path = new_path(spark)
    rows = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 7 == 3, F.lit("{broken")).otherwise(doc).alias("value"))
    rows.write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json_states(spark, path, "base_name string, completed_until_frame bigint")


JSON_STATES = "SELECT CASE WHEN n_nationkey % 7 <> 3 THEN n_name END AS base_name, CASE WHEN n_nationkey % 7 <> 3 THEN n_nationkey::BIGINT END AS completed_until_frame FROM nation"


def keep_existing_table(spark: SparkSession, d: str) -> DataFrame:
    """A table that exists stays unless the writer is told to replace it: small orders, then all, then urgent ones."""
    orders, path = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price")), new_path(spark)
    files.write_table(orders.where("price < 1000"), path)
    files.write_table(orders, path, force=True)
    files.write_table(orders.where("o_orderpriority = '1-URGENT'"), path, force=False)
    return spark.read.parquet(path)


KEEP_EXISTING_TABLE = "SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS price FROM orders"


def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    """The file that each page's short name means: whole names, without extension, and in other case."""
    there = _paths(spark, d).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    number = F.concat(F.lit("rec "), (F.col("page_id") % 60).cast("string"))
    wanted = F.when(F.col("page_id") % 3 == 0, number).when(F.col("page_id") % 3 == 1, F.concat(number, F.lit(" Speckle"))).otherwise(F.concat(F.upper(number), F.lit(" TOP")))
    return files.resolved(table(spark, d, "pages").select("page_id", wanted.alias("name")), there, ["page_id"])


RESOLVE_NAMES = rf"""
WITH {_PATHS_SQL},
f AS (SELECT DISTINCT regexp_extract(path, '([^/]+)$', 1) AS file FROM p),
w AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'rec ' || (page_id % 60) WHEN 1 THEN 'rec ' || (page_id % 60) || ' Speckle' ELSE upper('rec ' || (page_id % 60)) || ' TOP' END AS want FROM pages),
c AS (SELECT page_id, file, CASE file WHEN want THEN 0 WHEN want || '.mp4' THEN 1 WHEN want || ' LED.mp4' THEN 2 WHEN want || ' Fib.mp4' THEN 3 ELSE 4 END AS priority
  FROM w JOIN f ON file IN (want, want || '.mp4', want || ' LED.mp4', want || ' Fib.mp4') OR lower(regexp_replace(file, '\.[^.]+$', '')) = lower(want))
SELECT page_id, file AS name, priority FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY priority, file) = 1
"""


def assemble_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 100 events that overlap by 10: the later chunk's rows stay."""
    e = table(spark, d, "events").select("event_id", F.round("value", 6).alias("value"), F.floor(F.col("event_id") / 100).alias("chunk"))
    again = e.where("event_id % 100 < 10 and chunk > 0").withColumn("chunk", F.col("chunk") - 1).withColumn("value", F.lit(-1.0))
    chunks = e.unionByName(again).withColumn("range_start", F.col("chunk") * 100)
    return tables.assembled(chunks, [], "event_id").select("event_id", "range_start", "value")


ASSEMBLE_CHUNKS = "SELECT event_id, event_id // 100 * 100 AS range_start, round(value, 6) AS value FROM events"


def split_positional(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as rows of a frame, x values and y values."""
    out = tables.coordinates(table(spark, d, "embeddings"), "embedding")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double")), 6)
    return out.select("vec_id", F.size("xs").alias("n_x"), F.size("ys").alias("n_y"), total("xs").alias("x"), total("ys").alias("y"))


SPLIT_POSITIONAL = """
SELECT vec_id, 20 AS n_x, 20 AS n_y, round(list_sum(list_transform(embedding[2:21], lambda v: v::DOUBLE)), 6) AS x, round(list_sum(list_transform(embedding[22:41], lambda v: v::DOUBLE)), 6) AS y FROM embeddings
"""


def rename_kinds(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("Top", "Side", "LED", "Speckle", "Fib")))
    return table(spark, d, "part").select("p_partkey", tables.common_view(F.get(names, (F.col("p_size") % 5).cast("int"))).alias("kind"))


RENAME_KINDS = "SELECT p_partkey, ['Topview', 'Side', 'Fib', 'Fib', 'Fib'][p_size % 5 + 1] AS kind FROM part"


def required_columns(spark: SparkSession, d: str) -> DataFrame:
    """For each table, the required columns that it lacks."""
    wanted = {"orders": ["o_orderkey", "o_view", "o_frame"], "part": ["p_partkey"], "events": ["value", "frame", "event_id"]}
    rows = []
    for name, columns in wanted.items():
        try:
            tables.require(table(spark, d, name), columns)
            rows.append((name, ""))
        except ValueError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "name string, error string")


REQUIRED_COLUMNS = "SELECT * FROM (VALUES ('orders', 'missing columns: o_frame, o_view'), ('part', ''), ('events', 'missing columns: frame')) t(name, error)"


def prefix_columns(spark: SparkSession, d: str) -> DataFrame:
    """x_0 ... x_11 of a wide table whose columns stand in the order of their names."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", *(F.round(F.col("l_quantity") * i, 3).alias(f"{p}_{i}") for p in ("x", "y") for i in sorted(range(12), key=str)))
    out = tables.prefixed(l, ["l_orderkey"], "x_")
    return out.select("l_orderkey", F.concat_ws("|", *(F.col(c).cast("int").cast("string") for c in out.columns[1:])).alias("xs"))


PREFIX_COLUMNS = "SELECT l_orderkey, array_to_string(list_transform(range(12), lambda i: (l_quantity * i)::INT), '|') AS xs FROM lineitem"


def roi_windows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    window = crop_window((k * 37 % 640).cast("double"), (k * 91 % 480).cast("double"), (5 + F.col("p_size")).cast("double"), F.lit(640), F.lit(480))
    return table(spark, d, "part").select("p_partkey", window.alias("w")).where("w is not null").select("p_partkey", "w.x0", "w.y0", "w.x1", "w.y1")


ROI_WINDOWS = """
WITH c AS (SELECT p_partkey, greatest(p_partkey * 37 % 640 - 5 - p_size, 0)::INT AS x0, greatest(p_partkey * 91 % 480 - 5 - p_size, 0)::INT AS y0,
  least(p_partkey * 37 % 640 + 5 + p_size, 640)::INT AS x1, least(p_partkey * 91 % 480 + 5 + p_size, 480)::INT AS y1 FROM part)
SELECT * FROM c WHERE x1 - x0 >= 20 AND y1 - y0 >= 20
"""


def jump_gates(spark: SparkSession, d: str) -> DataFrame:
    near = small_jump((F.col("p_partkey") * 13 % 140).cast("double"), (40 + 2 * F.col("p_size")).cast("double"))
    return table(spark, d, "part").select("p_partkey", near.alias("accepted"))


JUMP_GATES = "SELECT p_partkey, p_partkey * 13 % 140 <= greatest(70.0::DOUBLE, 0.85::DOUBLE * (40 + 2 * p_size)) AS accepted FROM part"


def anchor_shift(spark: SparkSession, d: str) -> DataFrame:
    out = series.anchored(order_polylines(spark, d), ["l_orderkey"], ORDER_OF_LINES)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *r6("x", "y"))


ANCHOR_SHIFT = """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, l_extendedprice AS y FROM lineitem),
q AS (SELECT *, first_value(x) OVER w AS fx, last_value(x) OVER w AS lx, first_value(y) OVER w AS fy, last_value(y) OVER w AS ly FROM p
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, y, x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x - CASE WHEN fx >= lx THEN fx ELSE lx END, 6) AS x, round(y - CASE WHEN fx >= lx THEN fy ELSE ly END, 6) AS y FROM q
"""


def logits_mask(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of each embedding, read as logits, that belong to the mask."""
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter("embedding", is_mask)).cast("long").alias("area"))


LOGITS_MASK = "SELECT vec_id, len(list_filter(embedding, lambda v: v > 0)) AS area FROM embeddings"

QUERIES = {
    "read_spine_csv": (read_spine_csv, READ_SPINE_CSV),
    "write_wide_csv": (write_wide_csv, WRITE_WIDE_CSV),
    "json_states": (json_states, JSON_STATES),
    "keep_existing_table": (keep_existing_table, KEEP_EXISTING_TABLE),
    "resolve_names": (resolve_names, RESOLVE_NAMES),
    "assemble_chunks": (assemble_chunks, ASSEMBLE_CHUNKS),
    "split_positional": (split_positional, SPLIT_POSITIONAL),
    "rename_kinds": (rename_kinds, RENAME_KINDS),
    "required_columns": (required_columns, REQUIRED_COLUMNS),
    "prefix_columns": (prefix_columns, PREFIX_COLUMNS),
    "roi_windows": (roi_windows, ROI_WINDOWS),
    "jump_gates": (jump_gates, JUMP_GATES),
    "anchor_shift": (anchor_shift, ANCHOR_SHIFT),
    "logits_mask": (logits_mask, LOGITS_MASK),
}
