"""Operators on whole tables: parsing, projection, alignment, verification, chunks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

INTENSITY_COLUMN = r"^intensity_circle_(\d+)(?:_9pt_(\d+))?$"


def spine_numbers(text: Column) -> Column:
    """The numbers of the curve in a text, x and y in turn; null or none for a malformed one.

    Two forms are known: a list of pairs, and a run of np.int64(...) numbers in turn.
    Text is matched, never evaluated.
    """
    number = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
    listed = text.rlike(rf"^\s*\[\s*(\(\s*{number}\s*,\s*{number}\s*,?\s*\)\s*,?\s*)+\]\s*$")
    # In the first form, all that is no blank, bracket or comma belongs to a number.
    return F.when(listed, F.array_remove(F.split(text, r"[\s\[\](),]+"), "")).otherwise(F.regexp_extract_all(text, F.lit(r"np\.int64\((-?\d+)\)"), F.lit(1)))


def _curve(numbers: Column) -> Column:
    """Numbers in turn as an array of (x, y). A lambda's variable holds the numbers, as Spark finds a column used inside a lambda anew at each step."""
    half = lambda v: F.floor(F.size(v) / 2).cast("int")
    place = lambda v, i: F.struct(F.get(v, 2 * i).cast("double").alias("x"), F.get(v, 2 * i + 1).cast("double").alias("y"))
    pairs = lambda v: F.when(half(v) > 0, F.transform(F.sequence(F.lit(0), half(v) - 1), lambda i: place(v, i))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    return F.get(F.transform(F.array(numbers), pairs), F.lit(0))


def spine_points(text: Column) -> Column:
    """The curve in a text: array of (x, y) in its order; nothing for a malformed one."""
    return _curve(spine_numbers(text))


def frame_spines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row for each key: ``points``, the array of its curve. Different texts of one key give their points in turn, equal ones count once.

    Rows of a key meet in sorted order, and what is sorted are the texts as they came in.
    """
    w = W.partitionBy(*key).orderBy(text)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = df.select(*key, F.collect_set(text).over(whole).alias("_texts"), F.row_number().over(w).alias("_r")).where("_r = 1")
    place = lambda p, i: F.struct(i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))
    all_curves = F.array_distinct(F.transform("_texts", spine_numbers))
    in_turn = F.sort_array(F.flatten(F.transform(all_curves, lambda v: F.transform(_curve(v), place))))
    several = F.transform(in_turn, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return rows.select(*key, F.when(F.size("_texts") > 1, several).otherwise(spine_points(F.get("_texts", F.lit(0)))).alias("points"))


def parsed_spines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """A row for each point: key, point, x, y."""
    return df.select(*key, F.posexplode(spine_points(F.col(text))).alias("point", "p")).select(*key, "point", "p.x", "p.y")


def intensity_names(columns: list[str]) -> list[str]:
    """The frame column and the intensity columns, by circle, disc mean before the nine points."""
    found = [(int(m[1]), int(m[2] or 0), c) for c in columns if (m := re.match(INTENSITY_COLUMN, c))]
    return [c for c in columns if c == "Frame_ID"] + [c for _, _, c in sorted(found)]


def with_natural_order(df: DataFrame, name: str) -> DataFrame:
    """Column names as rows: adds circle and point, whose order is the natural one; other names go last."""
    circle, point = (F.regexp_extract(name, INTENSITY_COLUMN, i) for i in (1, 2))
    out = df.withColumn("circle", F.when(F.length(circle) > 0, circle.cast("long")).otherwise(F.lit(10**9)))
    out = out.withColumn("point", F.when(F.length(point) > 0, point.cast("long")).when(F.length(circle) > 0, F.lit(0)).otherwise(F.lit(10**9)))
    return out


def without_points(df: DataFrame) -> DataFrame:
    """Without the columns of single points."""
    return df.drop(*[c for c in df.columns if "pt_" in c])


def long_intensities(df: DataFrame, frame: str = "Frame_ID") -> DataFrame:
    """Wide to long: frame, circle, point (0: disc mean), value."""
    names = [c for c in intensity_names(df.columns) if c != frame]
    if not names:
        raise ValueError("no intensity columns")
    rows = df.unpivot(frame, names, "name", "value")
    return with_natural_order(rows, "name").select(frame, "circle", "point", "value")


def require(df: DataFrame, columns: list[str]) -> None:
    """Raises for columns that are missing."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def prefixed(df: DataFrame, keep: list[str], prefix: str) -> DataFrame:
    """``keep`` and the columns named by the prefix and a number, in the order of their numbers."""
    found = sorted((int(m[1]), c) for c in df.columns if (m := re.match(rf"{re.escape(prefix)}(\d+)$", c)))
    return df.select(*keep, *(c for _, c in found))


def coordinates(df: DataFrame, vector: str, points: int = 20) -> DataFrame:
    """Adds ``xs`` and ``ys``: values 1 to n and n + 1 to 2n of a row whose first value is its frame."""
    return df.withColumn("xs", F.slice(vector, 2, points)).withColumn("ys", F.slice(vector, points + 2, points))


def common_view(name: Column) -> Column:
    """The name that outputs use for a view or kind of recording."""
    return F.when(name == "Top", "Topview").when(name.isin("LED", "Speckle"), "Fib").otherwise(name)


def common_keys(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Keys that occur in every table."""
    return reduce(lambda a, b: a.intersect(b), [t.select(*key) for t in tables])


def aligned(tables: list[DataFrame], key: list[str]) -> list[DataFrame]:
    """Each table's rows with keys that all of them hold; rows that repeat a key stay."""
    common = common_keys(tables, key)
    return [t.join(common, key, "left_semi") for t in tables]


def root_relative(top: DataFrame, side: DataFrame, key: list[str], point: str = "point") -> DataFrame:
    """Points of two views on one root: mean x of both, less its first; each view's y less its own first."""
    t, s = top.select(*key, point, F.col("x").alias("tx"), F.col("y").alias("ty")), side.select(*key, point, F.col("x").alias("sx"), F.col("y").alias("sy"))
    both = t.join(s, [*key, point]).withColumn("x", (F.col("tx") + F.col("sx")) / 2)
    w = W.partitionBy(*key).orderBy(point)
    first = lambda c: F.first(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return both.select(*key, point, (F.col("x") - first("x")).alias("x"), (F.col("ty") - first("ty")).alias("top_y"), (F.col("sy") - first("sy")).alias("side_y"))


def verified(tables: dict[str, DataFrame], key: list[str], values: dict[str, list[str]], least: int = 60) -> DataFrame:
    """One row: rows and nulls of each table, keys common to all, and whether they pass."""
    counts = [
        t.agg(F.lit(n).alias("name"), F.count("*").alias("n_rows"), F.coalesce(F.sum(reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in values[n]])), F.lit(0)).alias("n_nulls"))
        for n, t in tables.items()
    ]
    common = common_keys(list(tables.values()), key).agg(F.count("*").alias("n_common"))
    out = reduce(lambda a, b: a.unionByName(b), counts).withColumn("n_common", common.scalar())
    return out.withColumn("passed", (F.col("n_nulls") == 0) & (F.col("n_common") > least))


def concatenated(tables: list[DataFrame]) -> DataFrame:
    """Recordings one after another, by column name; ``recording_ord`` tells them apart."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("recording_ord", F.lit(i)) for i, t in enumerate(tables)])


def chunk_ranges(df: DataFrame, total: str, size: int) -> DataFrame:
    """A row for each chunk: range_start, range_end (exclusive), tag."""
    starts = F.when(F.col(total) > 0, F.sequence(F.lit(0).cast("long"), F.col(total) - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = df.withColumn("range_start", F.explode(starts)).withColumn("range_end", F.least(F.col("range_start") + size, F.col(total)))
    return rows.withColumn("tag", F.format_string("__%06d-%06d", "range_start", F.col("range_end") - 1))


def complete_chunks(ranges: DataFrame, done: DataFrame, key: list[str], frame: str) -> DataFrame:
    """Adds ``found`` and ``complete``: whether every frame of the range was written.

    Frames find their range by its number, so the join is one of equals.
    """
    size = F.max(F.col("range_end") - F.col("range_start")).over(W.partitionBy(*key))
    numbered = ranges.withColumn("_size", size).withColumn("_chunk", F.floor(F.col("range_start") / F.col("_size")))
    sizes = numbered.groupBy(*key).agg(F.max("_size").alias("_size"))
    hits = done.select(*key, frame).distinct().join(sizes, key).withColumn("_chunk", F.floor(F.col(frame) / F.col("_size")))
    found = hits.groupBy(*key, "_chunk").agg(F.count("*").alias("found"))
    out = numbered.join(found, [*key, "_chunk"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.withColumn("complete", F.col("found") >= F.col("range_end") - F.col("range_start")).drop("_size", "_chunk")


def coverage_breaks(ranges: DataFrame, key: list[str], total: str) -> DataFrame:
    """Where completed ranges do not join end to end from 0 to the total: after, expected next start."""
    longest = ranges.groupBy(*key, total, "range_start").agg(F.max("range_end").alias("range_end"))
    w = W.partitionBy(*key).orderBy("range_start")
    rows = longest.withColumn("expected", F.coalesce(F.lag("range_end").over(w), F.lit(0).cast("long")))
    inner = rows.where("range_start <> expected").select(*key, "expected", F.col("range_start").alias("found"))
    last = longest.groupBy(*key, total).agg(F.max("range_end").alias("expected")).where(F.col("expected") != F.col(total))
    return inner.unionByName(last.select(*key, "expected", F.col(total).cast("long").alias("found")))


def assembled(chunks: DataFrame, key: list[str], frame: str) -> DataFrame:
    """Chunk outputs in range order; of a frame that two chunks hold, the later chunk's row."""
    w = W.partitionBy(*key, frame).orderBy(F.col("range_start").desc())
    return chunks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def furthest_end(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Per start, the longest of repeated ranges: where a resumed run goes on."""
    return ranges.groupBy(*key, "range_start").agg(F.max("range_end").alias("range_end"))


def training_matrix(features: DataFrame, side: DataFrame, top: DataFrame, key: list[str], vector: str) -> DataFrame:
    """One row for each key that all three hold once: features, and the targets side before top. A repeated key is an error."""
    named = [df.groupBy(*key).agg(F.first(vector).alias(n), F.count("*").alias(f"_{n}")) for df, n in ((features, "x"), (side, "s"), (top, "t"))]
    rows = reduce(lambda a, b: a.join(b, key), named)
    once = F.when(F.greatest("_x", "_s", "_t") > 1, F.raise_error("a key is repeated").cast("int"))
    return rows.select(*key, F.when(once.isNull(), F.col("x")).alias("x"), F.concat("s", "t").alias("y"))
