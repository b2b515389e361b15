"""Operators on rasters as tables of pixels: frame, px, py, gray."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.scalar import half_even


def max_projection(pixels: DataFrame) -> DataFrame:
    """The brightest value at each place over all frames, and how many frames there are; a frame holds a place once."""
    return pixels.groupBy("px", "py").agg(F.max("gray").alias("gray"), F.count("frame").alias("frames"))


def window_rows(places: DataFrame, x: Column, y: Column, half: Column, width: int, height: int) -> DataFrame:
    """A row for each pixel of the square around (x, y), cut at the frame's border."""
    xs = F.sequence(F.greatest(x - half, F.lit(0)), F.least(x + half, F.lit(width - 1)))
    ys = F.sequence(F.greatest(y - half, F.lit(0)), F.least(y + half, F.lit(height - 1)))
    inside = (x + half >= 0) & (x - half <= width - 1) & (y + half >= 0) & (y - half <= height - 1)
    empty = F.array().cast("array<bigint>")
    out = places.withColumn("px", F.explode_outer(F.when(inside, xs).otherwise(empty)))
    return out.withColumn("py", F.explode_outer(F.when(inside, ys).otherwise(empty)))


def disc_means(pixels: DataFrame, circles: DataFrame, width: int, height: int) -> DataFrame:
    """Mean gray of every circle's disc in every frame: frame, circle, value.

    Circles list the pixels they cover, which then join by place; pixels are
    never paired with circles that do not hold them.
    """
    x, y, r = (half_even(F.col(c)) for c in ("x", "y", "r"))
    covered = window_rows(circles.select("circle", "x", "y", "r"), x, y, r, width, height)
    covered = covered.where((F.col("px") - x) * (F.col("px") - x) + (F.col("py") - y) * (F.col("py") - y) <= r * r)
    return covered.join(pixels, ["px", "py"]).groupBy("frame", "circle").agg(F.avg("gray").alias("value"))


def sample_points(circles: DataFrame, key: list[str] | None = None, share: float = 0.6) -> DataFrame:
    """The centre (point 1) and eight points of a ring (2 to 9) of every circle: key (circle by default), point, sx, sy."""
    key = key or ["circle"]
    ring = [F.struct(F.lit(1).alias("point"), F.col("x").alias("sx"), F.col("y").alias("sy"))]
    for i in range(8):
        angle = F.radians(F.lit(45.0 * i))
        ring.append(F.struct(F.lit(i + 2).alias("point"), (F.col("x") + share * F.col("r") * F.cos(angle)).alias("sx"), (F.col("y") + share * F.col("r") * F.sin(angle)).alias("sy")))
    return circles.select(*key, F.explode(F.array(*ring)).alias("p")).select(*key, "p.point", "p.sx", "p.sy")


def patch_means(pixels: DataFrame, points: DataFrame, width: int, height: int, half: int = 2) -> DataFrame:
    """Mean gray of the square around every sample point of a frame: frame, circle, point, value; 0 outside the frame.

    Points name their frame, as centres move with it, so pixels join by frame and place.
    """
    x, y = half_even(F.round("sx", 9)), half_even(F.round("sy", 9))
    covered = window_rows(points, x, y, F.lit(half).cast("long"), width, height)
    held = covered.join(pixels, ["frame", "px", "py"], "left")
    return held.groupBy("frame", "circle", "point").agg(F.coalesce(F.avg("gray"), F.lit(0.0)).alias("value"))


def window_means(pixels: DataFrame, circles: DataFrame, width: int, height: int) -> DataFrame:
    """Mean gray of the square of a quarter radius (eight pixels at least) around each centre."""
    half = F.greatest(F.lit(8).cast("long"), half_even(F.col("r") * 0.25))
    covered = window_rows(circles, half_even(F.col("x")), half_even(F.col("y")), half, width, height)
    return covered.join(pixels, ["px", "py"]).groupBy("frame", "circle").agg(F.avg("gray").alias("value"))


def pooled_mean(pixels: DataFrame, circles: DataFrame, width: int, height: int) -> DataFrame:
    """Per frame, one mean of all pixels strictly inside any circle, each counted for every circle that holds it."""
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    covered = window_rows(circles, F.floor(x), F.floor(y), F.ceil(r) + 1, width, height)
    covered = covered.where((F.col("px") - x) * (F.col("px") - x) + (F.col("py") - y) * (F.col("py") - y) < r * r)
    return covered.join(pixels, ["px", "py"]).groupBy("frame").agg(F.avg("gray").alias("value"), F.count("*").alias("n"))


def circle_evidence(pixels: DataFrame, circles: DataFrame, width: int, height: int, threshold: float = 8.0) -> DataFrame:
    """How much each circle stands out in each frame: inner mean less ring mean, plus 40 times the share of clear edges; 0 where it holds no pixel.

    Circles are the candidates of one recording, few enough for a list of their names.
    """
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    covered = window_rows(circles, F.floor(x), F.floor(y), F.ceil(r * 1.35) + 1, width, height)
    far = F.sqrt((F.col("px") - x) * (F.col("px") - x) + (F.col("py") - y) * (F.col("py") - y))
    inner, ring = far <= r * 0.75, (far >= r * 1.05) & (far <= r * 1.35)
    held = covered.withColumn("inner", inner).withColumn("ring", ring).where("inner or ring").join(pixels, ["px", "py"])
    level = held.groupBy("frame", "circle").agg(F.avg(F.when(F.col("inner"), F.col("gray"))).alias("a"), F.avg(F.when(F.col("ring"), F.col("gray"))).alias("b"))
    angle = F.col("i") * F.lit(2 * 3.141592653589793 / 64)
    at = lambda share, f, c: half_even(F.round(c + f(angle) * r * share, 9))
    edges = circles.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    edges = edges.select("circle", "i", at(0.82, F.cos, x).alias("px"), at(0.82, F.sin, y).alias("py"), at(1.12, F.cos, x).alias("qx"), at(1.12, F.sin, y).alias("qy"))
    outer = pixels.select("frame", F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("gray").alias("outer_gray"))
    both = edges.join(pixels, ["px", "py"]).join(outer, ["frame", "qx", "qy"])
    share = both.groupBy("frame", "circle").agg(F.avg((F.col("gray") - F.col("outer_gray") > threshold).cast("int")).alias("share"))
    names = circles.agg(F.collect_list("circle")).scalar()
    every = pixels.select("frame").distinct().select("frame", F.explode(names).alias("circle"))
    out = every.join(level, ["frame", "circle"], "left").join(share, ["frame", "circle"], "left")
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.col("a") - F.col("b") + 40.0 * F.coalesce("share", F.lit(0.0)))
    return out.select("frame", "circle", score.alias("score"))


def black_bars(pixels: DataFrame, dark: float = 25.0, least: int = 20) -> DataFrame:
    """Width of the dark border at either side of each frame; a narrow one counts as none."""
    columns = pixels.groupBy("frame", "px").agg(F.avg("gray").alias("mean"))
    bright = F.when(F.col("mean") >= dark, F.col("px"))
    ends = columns.groupBy("frame").agg(F.min(bright).alias("a"), F.max(bright).alias("b"), (F.max("px") + 1).alias("width"))
    left, right = F.coalesce("a", "width"), F.coalesce(F.col("width") - 1 - F.col("b"), F.col("width"))
    wide = lambda c: F.when(c < least, 0).otherwise(c).cast("long")
    return ends.select("frame", wide(left).alias("left"), wide(right).alias("right"))


def mask_shape(mask: DataFrame, spine: DataFrame) -> DataFrame:
    """Per frame: area (mask pixels), length (spine pixels), thickness (area by length, 0 without length)."""
    area = mask.groupBy("frame").agg(F.count("*").alias("area"))
    length = spine.groupBy("frame").agg(F.count("*").alias("length"))
    out = area.join(length, "frame", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    return out.withColumn("thickness", F.when(F.col("length") > 0, F.col("area") / F.col("length")).otherwise(0.0))


def unboxed(pixels: DataFrame, scale: Column, pad_left: Column, pad_top: Column, crop_left: Column) -> DataFrame:
    """Pixels of a letterboxed square, mapped to the nearest of the full frame."""
    x = F.floor((F.col("px") - pad_left + 0.5) / scale) + crop_left
    y = F.floor((F.col("py") - pad_top + 0.5) / scale)
    return pixels.withColumn("px", x).withColumn("py", y).distinct()


def sampled_frames(counts: DataFrame, key: list[str], total: str, stride: int) -> DataFrame:
    """Frames 0, stride, 2 * stride, ... and the middle one, each once: key, frame_id."""
    every = F.sequence(F.lit(0).cast("long"), F.col(total) - 1, F.lit(stride).cast("long"))
    middle = F.array(F.floor(F.col(total) / 2))
    return counts.where(F.col(total) > 0).select(*key, F.explode(F.array_distinct(F.concat(every, middle))).alias("frame_id"))


def candidate_evidence(scores: DataFrame, key: list[str], score: str) -> DataFrame:
    """Ninetieth percentile and median of each candidate's scores; 0 without any."""
    return scores.groupBy(*key).agg(F.coalesce(F.percentile(score, 0.9), F.lit(0.0)).alias("evidence_p90"), F.coalesce(F.median(score), F.lit(0.0)).alias("evidence_median"))


def spine_pixels(pixels: DataFrame, frame: str) -> DataFrame:
    """Per frame, its pixels by x, then y (not along the path), and their number."""
    return pixels.groupBy(frame).agg(F.sort_array(F.collect_list(F.struct("px", "py"))).alias("spine"), F.count("*").alias("length"))
