"""Graph operators on tables of edges and pixels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.staging import Scratch, staged


def neighbours(pixels: DataFrame, key: list[str], x: str = "px", y: str = "py") -> DataFrame:
    """Pairs of pixels that touch, by side or corner, in both directions: key, px, py, qx, qy.

    Every pixel asks for its eight places, so the join is one of equals.
    """
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    asked = pixels.select(*key, F.col(x).alias("px"), F.col(y).alias("py"), F.explode(around).alias("s"))
    asked = asked.select(*key, "px", "py", (F.col("px") + F.col("s.i")).alias("qx"), (F.col("py") + F.col("s.j")).alias("qy"))
    return asked.join(pixels.select(*key, F.col(x).alias("qx"), F.col(y).alias("qy")), [*key, "qx", "qy"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are tied to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node itself, are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none."""
    up = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = up.unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every id in edges (a, b), with the smallest id it can reach.

    Alternating large and small stars: edges never grow in number, nothing
    reaches the driver but whether a round left anything to do, and each round
    is written so that lineage stays short, and the one before it deleted. Edges
    to oneself are dropped.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    before = None
    while True:
        now = Scratch(edges.sparkSession)
        edges = now.put(_small_star(_large_star(edges)))
        if before is not None:
            before.clear()
        if _done(edges):
            break
        before = now
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("component")), F.struct(F.col("b").alias("id"), F.col("b").alias("component")))
    return edges.select(F.explode(ends).alias("x")).select("x.id", "x.component").distinct()


def pixel_id(x: Column, y: Column, frame: Column) -> Column:
    """One number for a pixel of a frame, in order of frame, row, column."""
    return F.shiftleft(frame.cast("long"), 40) + F.shiftleft(y.cast("long"), 20) + x.cast("long")


def _pieces(pixels: DataFrame, frame: str) -> DataFrame:
    """Pixels with the component (least pixel id) that they belong to; rows without a frame or a place belong to none."""
    own = pixels.select(F.col(frame).cast("long").alias(frame), F.col("px").cast("long"), F.col("py").cast("long")).dropna().distinct()
    own = own.withColumn("id", pixel_id(F.col("px"), F.col("py"), F.col(frame)))
    pairs = neighbours(own, [frame])
    edges = pairs.select(pixel_id(F.col("px"), F.col("py"), F.col(frame)).alias("a"), pixel_id(F.col("qx"), F.col("qy"), F.col(frame)).alias("b")).where("a < b")
    return own.join(components(edges), "id", "left").withColumn("component", F.coalesce("component", "id"))


def large_components(pixels: DataFrame, frame: str, least: int) -> DataFrame:
    """frame, component (least pixel id), area: pieces of touching pixels of at least this area."""
    return _pieces(pixels, frame).groupBy(frame, "component").agg(F.count("*").alias("area")).where(F.col("area") >= least)


def component_pixels(pixels: DataFrame, frame: str, least: int) -> DataFrame:
    """The pixels (frame, px, py) of pieces of at least this area."""
    named = staged(_pieces(pixels, frame))
    large = named.groupBy("component").agg(F.count("*").alias("area")).where(F.col("area") >= least)
    return named.join(large, "component", "left_semi").select(frame, "px", "py")


#: Steps to the places around a pixel.
_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def _farthest(start: int, around: dict[int, list[int]]) -> tuple[int, dict[int, int | None]]:
    """The pixel farthest from ``start``, of equals the least, and every reached pixel's parent, the least of those one step nearer."""
    parent, front = {start: None}, [start]
    while True:
        fresh: dict[int, int | None] = {}
        for a in sorted(front):
            for b in around[a]:
                if b not in parent:
                    fresh.setdefault(b, a)
        if not fresh:
            return min(front), parent
        parent |= fresh
        front = list(fresh)


def longest_path(pixels: DataFrame, frame: str) -> DataFrame:
    """Pixels of the longest route through each frame's tree of pixels: frame, step, id.

    The farthest pixel from some end, then the farthest from that one, and the
    way between; the least pixel id breaks ties. Frames are grouped to a row of
    their pixels each, and tasks take batches of frames: one frame holds no more
    pixels than its raster, however many frames there are.
    """
    own = pixels.select(F.col(frame).cast("long").alias("frame"), F.col("px").cast("long"), F.col("py").cast("long")).dropna()
    grouped = own.groupBy("frame").agg(F.collect_set(F.struct("px", "py")).alias("_at"))

    def route(f: int, places: list[tuple[int, int]]) -> list[int]:
        number = {(x, y): (f << 40) + (y << 20) + x for x, y in places}
        around = {n: [number[q] for q in ((x + i, y + j) for i, j in _AROUND) if q in number] for (x, y), n in number.items()}
        start, _ = _farthest(min((n for n, near in around.items() if len(near) == 1), default=min(around)), around)
        at, parent = _farthest(start, around)
        path = [at]
        while (at := parent[at]) is not None:
            path.append(at)
        return path[::-1]

    def routes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ends, (xs, ys) = part["_at"].offsets.to_pylist(), (v.to_pylist() for v in part["_at"].values.flatten())
            paths = [(f, route(f, list(zip(xs[a:b], ys[a:b])))) for f, a, b in zip(part["frame"].to_pylist(), ends, ends[1:])]
            columns = ([f for f, p in paths for _ in p], [i for _, p in paths for i in range(len(p))], [n for _, p in paths for n in p])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()))], ["frame", "step", "id"])

    out = grouped.mapInArrow(routes, "frame long, step int, id long")
    return out.select(F.col("frame").alias(frame), "step", "id")


def greedy_independent(vertices: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id) kept when vertices are taken in order of id and one that conflicts with a kept one is left out.

    Conflicts are (a, b) with a < b. Rounds keep all undecided vertices without
    an undecided smaller neighbour and drop the neighbours of the kept ones.
    """
    edges = staged(conflicts.select("a", "b").distinct())
    state = vertices.select("id").distinct().withColumn("kept", F.lit(None).cast("boolean"))
    while True:
        free = state.where("kept is null").select("id")
        waiting = edges.join(free.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct()
        chosen = free.join(waiting, "id", "left_anti")
        lost = edges.join(chosen.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct().withColumn("lost", F.lit(True))
        state = state.join(chosen.withColumn("won", F.lit(True)), "id", "left").join(lost, "id", "left")
        state = staged(state.select("id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("won"), True).when(F.col("lost"), False).alias("kept")))
        if state.where("kept is null").isEmpty():
            return state.where("kept").select("id")
