"""Filters on pixel tables (frame, px, py, gray): blur, gradient, circle voting, local contrast, mask cleanup, thinning.

Rows are dealt by frame once; everything that groups by frame and place then
stays in its task, which holds a part of the frames and no more of one than its
raster. Weights are whole numbers and so are all sums, so results do not depend
on the order in which pixels arrive. Beyond a border a frame is mirrored about
its outermost pixels (which are not repeated); pixels that a table lacks are 0.
Rows without a frame or a place are left out. A place that a frame holds twice
counts twice in sums.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesforge.functions.staging import staged
from seriesforge.operators.circles import separated
from seriesforge.operators.graph import component_pixels

#: Sum of the weights of a blur along one axis.
UNIT = 4096
#: Central differences, and the smoothing across them.
DIFFERENCE, SMOOTHING = (-1, 0, 1), (1, 2, 1)


def gaussian(sigma: float, radius: int) -> tuple[int, ...]:
    """Whole weights of a Gaussian that add up to ``UNIT``; the middle one takes what rounding leaves."""
    raw = [exp(-i * i / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    out = [round(UNIT * w / sum(raw)) for w in raw]
    out[radius] += UNIT - sum(out)
    return tuple(out)


def by_frame(pixels: DataFrame, *columns: Column | str) -> DataFrame:
    """The pixels dealt by frame."""
    place = [F.col(c).cast("long").alias(c) for c in ("frame", "px", "py")]
    return pixels.select(*place, *columns).dropna(subset=["frame", "px", "py"]).repartition("frame")


def mirrored(at: Column, size: int, reach: int) -> Column:
    """The places where a pixel is seen when the frame is mirrored ``reach`` pixels beyond its borders."""
    far = 2 * (size - 1) - at
    return F.array_compact(F.array(at, F.when((at >= 1) & (at <= reach), -at), F.when((at <= size - 2) & (far <= size - 1 + reach), far)))


def along(rows: DataFrame, axis: str, size: int, sums: dict[str, tuple[str, tuple[int, ...]]]) -> DataFrame:
    """Weighted sums along an axis: each output is (column, weights), all of one odd length below twice the frame's size."""
    n = len(next(iter(sums.values()))[1])
    reach = n // 2
    if reach >= size:
        raise ValueError("the weights reach beyond the mirrored frame")
    other = "py" if axis == "px" else "px"
    seen = rows.withColumn("_at", F.explode(mirrored(F.col(axis), size, reach)))
    lists = F.arrays_zip(*(F.array(*map(F.lit, w)).alias(f"w{i}") for i, (_, w) in enumerate(sums.values())))
    seen = seen.select("frame", other, "_at", *{c for c, _ in sums.values()}, F.posexplode(lists).alias("_k", "_w"))
    seen = seen.withColumn(axis, F.col("_at") - F.col("_k") + reach).where(F.col(axis).between(0, size - 1))
    return seen.groupBy("frame", "px", "py").agg(*(F.sum(F.col(c) * F.col("_w")[f"w{i}"].cast("long")).alias(out) for i, (out, (c, _)) in enumerate(sums.items())))


def blurred(pixels: DataFrame, width: int, height: int, sigma: float = 2.0, radius: int = 4) -> DataFrame:
    """Gray values smoothed by a Gaussian, as whole numbers."""
    w = gaussian(sigma, radius)
    rows = by_frame(pixels, F.round("gray").cast("long").alias("gray"))
    rows = along(along(rows, "px", width, {"gray": ("gray", w)}), "py", height, {"gray": ("gray", w)})
    return rows.withColumn("gray", F.floor((F.col("gray") + UNIT * UNIT // 2) / (UNIT * UNIT)))


def gradients(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """gx, gy: differences along each axis, smoothed across it."""
    rows = by_frame(pixels, F.col("gray").cast("long").alias("gray"))
    rows = along(rows, "px", width, {"d": ("gray", DIFFERENCE), "s": ("gray", SMOOTHING)})
    return along(rows, "py", height, {"gx": ("d", SMOOTHING), "gy": ("s", DIFFERENCE)})


def edges(smooth: DataFrame, width: int, height: int, least: int = 45) -> DataFrame:
    """Pixels whose gradient is at least this strong."""
    return gradients(smooth, width, height).where(F.abs("gx") + F.abs("gy") >= least)


def votes(edge: DataFrame, width: int, height: int, low: int, high: int, cell: float = 1.2) -> DataFrame:
    """Per frame and cell of ``cell`` pixels: how many edge pixels have a centre there, at some radius, along their gradient."""
    radius = F.concat(F.sequence(F.lit(-high), F.lit(-low)), F.sequence(F.lit(low), F.lit(high)))
    norm = F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))
    rows = edge.withColumn("_n", norm).withColumn("_r", F.explode(radius))
    at = lambda p, g: F.col(p) + F.col("_r") * F.col(g) / F.col("_n")
    rows = rows.select("frame", at("px", "gx").alias("x"), at("py", "gy").alias("y")).where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    return rows.groupBy("frame", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.count("*").alias("votes"))


def peaks(table: DataFrame, least: int) -> DataFrame:
    """Cells with at least so many votes, more than the cells before and no fewer than the cells after, by row and by column."""
    seen = ((0, 0, "own"), (1, 0, "before"), (0, 1, "before"), (-1, 0, "after"), (0, -1, "after"))
    told = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in seen)))
    rows = table.withColumn("_t", told).select("frame", (F.col("cx") + F.col("_t.i")).alias("cx"), (F.col("cy") + F.col("_t.j")).alias("cy"), "votes", F.col("_t.w").alias("_w"))
    most = lambda w: F.max(F.when(F.col("_w") == w, F.col("votes"))).alias(w)
    rows = rows.groupBy("frame", "cx", "cy").agg(most("own"), most("before"), most("after"))
    none = F.lit(0)
    return rows.where((F.col("own") >= least) & (F.col("own") > F.coalesce("before", none)) & (F.col("own") >= F.coalesce("after", none))).select("frame", "cx", "cy", F.col("own").alias("votes"))


def found_circles(pixels: DataFrame, width: int, height: int, low: int, high: int, least: int, apart: float, edge: int = 45, cell: float = 1.2, sigma: float = 2.0, reach: int = 4) -> DataFrame:
    """frame, x, y, r, votes: circles that the edges of each frame vote for, best first and ``apart`` pixels from better ones.

    A circle's radius is that at which most edge pixels stand around its centre, for its length.
    """
    edge_pixels = staged(edges(blurred(pixels, width, height, sigma, reach), width, height, edge))
    found = peaks(votes(edge_pixels, width, height, low, high, cell), least)
    number = (F.col("cy") * (int(width / cell) + 1) + F.col("cx")).alias("cluster")
    at = lambda c: ((F.col(c) + 0.5) * cell).alias(c[1])
    found = found.select("frame", "votes", at("cx"), at("cy"), number, F.lit(0.0).alias("r"), F.lit(float(apart)).alias("_apart"), F.lit(2**31 - 1).alias("_most"))
    kept = separated(found, ["frame"], [-F.col("votes")], "_apart", "_most").select("frame", "cluster")
    kept = found.join(kept, ["frame", "cluster"], "left_semi").select("frame", "cluster", "x", "y", "votes")
    block = lambda c: F.floor(F.col(c) / (high + 1))  # noqa: E731 - a pixel counts up to half a pixel beyond the radius
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    asked = kept.withColumn("_s", around).withColumn("_bx", block("x") + F.col("_s.i")).withColumn("_by", block("y") + F.col("_s.j")).drop("_s")
    near = asked.join(edge_pixels.select("frame", "px", "py", block("px").alias("_bx"), block("py").alias("_by")), ["frame", "_bx", "_by"])
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    rings = near.withColumn("r", F.floor(F.sqrt(dx * dx + dy * dy) + 0.5)).where(F.col("r").between(low, high)).groupBy("frame", "cluster", "r").agg(F.count("*").alias("n"))
    best = rings.groupBy("frame", "cluster").agg(F.min_by("r", F.struct((-F.col("n") / F.col("r")).alias("a"), "r")).alias("r"))
    return kept.join(best, ["frame", "cluster"]).select("frame", "x", "y", F.col("r").cast("double").alias("r"), "votes")


def equalised(pixels: DataFrame, width: int, height: int, tiles: int = 8, limit: float = 3.0) -> DataFrame:
    """Gray values (0 to 255) spread by the histograms of the four tiles around each pixel, clipped so that noise stays low.

    Counts of a tile above the limit are dealt evenly to all values. Frames that tiles do not divide are mirrored
    at their far borders. Blends round half up.
    """
    w, h = -(-width // tiles), -(-height // tiles)
    area = w * h
    most = max(1, int(limit * area / 256))
    rows = by_frame(pixels, F.greatest(F.lit(0), F.least(F.lit(255), F.round("gray"))).cast("long").alias("gray"))

    def images(at: Column, size: int, padded: int) -> Column:
        far = 2 * (size - 1) - at
        return F.array_compact(F.array(at, F.when((far >= size) & (far < padded), far)))

    seen = rows.withColumn("_x", F.explode(images(F.col("px"), width, w * tiles))).withColumn("_y", F.explode(images(F.col("py"), height, h * tiles)))
    counts = seen.groupBy("frame", F.floor(F.col("_x") / w).alias("tx"), F.floor(F.col("_y") / h).alias("ty"), "gray").agg(F.count("*").alias("n"))
    held = counts.groupBy("frame", "tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct("gray", "n"))).alias("m"))  # 256 values at most
    bins = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    held = held.withColumn("b", bins).withColumn("over", F.aggregate("b", F.lit(0).cast("long"), lambda s, n: s + F.greatest(n - most, F.lit(0))))
    rest = F.col("over") % 256
    step = F.greatest(F.floor(256 / F.greatest(rest, F.lit(1))), F.lit(1))
    held = held.select("frame", "tx", "ty", "over", rest.alias("rest"), step.alias("step"), F.posexplode("b").alias("gray", "n"))
    extra = F.when((F.col("gray") % F.col("step") == 0) & (F.floor(F.col("gray") / F.col("step")) < F.col("rest")), 1).otherwise(0)
    held = held.withColumn("n", F.least("n", F.lit(most)) + F.floor(F.col("over") / 256) + extra)
    below = F.sum("n").over(W.partitionBy("frame", "tx", "ty").orderBy("gray"))
    maps = held.withColumn("_to", F.floor((2 * below * 255 + area) / (2 * area))).select("frame", "tx", "ty", F.col("gray").cast("long").alias("gray"), F.least("_to", F.lit(255)).alias("_to"))

    def sides(at: str, side: int) -> Column:
        """The tiles before and after a pixel, and their weights out of twice the tile's side."""
        first = F.floor((2 * F.col(at) - side) / (2 * side))
        share = 2 * F.col(at) - side - first * 2 * side
        inside = lambda t: F.greatest(F.lit(0), F.least(F.lit(tiles - 1), t)).cast("long").alias("t")
        return F.array(F.struct(inside(first), (2 * side - share).alias("w")), F.struct(inside(first + 1), share.alias("w")))

    asked = rows.withColumn("_a", F.explode(sides("px", w))).withColumn("_b", F.explode(sides("py", h)))
    asked = asked.select("frame", "px", "py", "gray", F.col("_a.t").alias("tx"), F.col("_b.t").alias("ty"), (F.col("_a.w") * F.col("_b.w")).alias("_w"))
    mixed = asked.join(maps, ["frame", "tx", "ty", "gray"]).groupBy("frame", "px", "py").agg(F.sum(F.col("_w") * F.col("_to")).alias("_v"))
    return mixed.select("frame", "px", "py", F.floor((F.col("_v") + 2 * area) / (4 * area)).alias("gray"))


def cleaned_mask(mask: DataFrame, width: int, height: int, least: int, sigma: float = 3.0, radius: int = 12) -> DataFrame:
    """Mask pixels (frame, px, py) without small pieces, and with smooth borders: where the blurred mask exceeds a half."""
    w = gaussian(sigma, radius)
    rows = by_frame(component_pixels(mask, "frame", least), F.lit(1).cast("long").alias("m"))
    rows = along(along(rows, "px", width, {"m": ("m", w)}), "py", height, {"m": ("m", w)})
    return rows.where(F.col("m") * 2 > UNIT * UNIT).select("frame", "px", "py")


#: The neighbours of a pixel, clockwise from the one above; a neighbour's bit in a code is its place here.
RING = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def may_go(code: int, second: bool) -> bool:
    """Whether a pixel with these neighbours is a removable border pixel of the first or the second half of a round."""
    p = [code >> i & 1 for i in range(8)]
    turns = sum(not a and b for a, b in zip(p, p[1:] + p[:1]))
    up, right, down, left = p[0], p[2], p[4], p[6]
    open_ = not (up and right and left) and not (up and down and left) if second else not (up and right and down) and not (right and down and left)
    return 2 <= sum(p) <= 6 and turns == 1 and open_


def thinned(mask: DataFrame) -> DataFrame:
    """Mask pixels thinned to lines, half round by half round, each over all frames at once.

    Every pixel tells its neighbours where they stand to it, so a pixel's code is one grouping by place. Rounds end
    when none removes a pixel, after about half the thickness of the thickest mask; each is staged.
    """
    rows = staged(by_frame(mask).distinct())
    left = rows.count()
    told = [(0, 0, 0, True)] + [(-i, -j, 1 << bit, False) for bit, (i, j) in enumerate(RING)]
    tell = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(c).alias("c"), F.lit(own).alias("own")) for i, j, c, own in told))
    while left:
        for second in (False, True):
            goes = F.array(*(F.lit(may_go(code, second)) for code in range(256)))
            seen = rows.withColumn("_t", F.explode(tell)).select("frame", (F.col("px") + F.col("_t.i")).alias("px"), (F.col("py") + F.col("_t.j")).alias("py"), F.col("_t.c").alias("c"), F.col("_t.own").alias("own"))
            rows = seen.groupBy("frame", "px", "py").agg(F.sum("c").cast("int").alias("c"), F.max("own").alias("own")).where(F.col("own") & ~F.get(goes, F.col("c"))).select("frame", "px", "py")
        rows = staged(rows)
        before, left = left, rows.count()
        if left == before:
            break
    return rows
