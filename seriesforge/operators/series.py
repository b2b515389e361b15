"""Operators on ordered series: tables keyed by series columns and an order.

Each works on one series at a time by a window over the series key, so one
shuffle by that key serves a chain of them. Missing values are nulls, never NaN.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesforge.functions.ranking import positioned
from seriesforge.functions.scalar import odd_window


def _upto(key: list[str], order: list[str]) -> W:
    return W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def arc_length(df: DataFrame, key: list[str], order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``arc``: the way along the polyline from its first point."""
    w = W.partitionBy(*key).orderBy(*order)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return df.withColumn("_step", step).withColumn("arc", F.sum("_step").over(_upto(key, order))).drop("_step")


def oriented(df: DataFrame, key: list[str], order: list[str], x: str = "x") -> DataFrame:
    """Adds ``pos`` (0, 1, ...): polylines that run from small to large x are turned round."""
    w = W.partitionBy(*key).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turned = F.first(x).over(whole) < F.last(x).over(whole)
    n = F.count("*").over(W.partitionBy(*key))
    rank = F.row_number().over(w) - 1
    return df.withColumn("pos", F.when(turned, n - 1 - rank).otherwise(rank))


def resampled(df: DataFrame, key: list[str], order: list[str], n: int, by_index: bool, x: str = "x", y: str = "y") -> DataFrame:
    """``n`` points of each polyline at equal arc length: key, point (0..n-1), x, y.

    Every segment makes the grid points that fall on it, so no join is needed.
    A polyline without length is followed by index (``by_index``) or repeats
    its first point. Polylines of one point are dropped.
    """
    w = W.partitionBy(*key).orderBy(*order)
    rows = arc_length(df, key, order, x, y)
    rows = rows.withColumn("_n", F.count("*").over(W.partitionBy(*key))).where("_n > 1")
    rows = rows.withColumn("_total", F.max("arc").over(W.partitionBy(*key)))
    flat = F.col("_total") <= 0
    if by_index:
        rows = rows.withColumn("_s", F.when(flat, (F.row_number().over(w) - 1).cast("double")).otherwise(F.col("arc")))
        rows = rows.withColumn("_all", F.when(flat, F.col("_n") - 1.0).otherwise(F.col("_total")))
    else:
        rows = rows.withColumn("_s", F.col("arc")).withColumn("_all", F.col("_total"))
    rows = rows.withColumn("_s1", F.lead("_s").over(w)).withColumn("_x1", F.lead(x).over(w)).withColumn("_y1", F.lead(y).over(w))
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("_first", first).where("_s1 > _s or (_all <= 0 and _first)")
    u = lambda k: F.col("_all") * k / (n - 1)
    near = lambda s: F.col(s) * (n - 1) / F.col("_all")
    low, high = F.greatest(F.floor(near("_s")) - 1, F.lit(0)), F.least(F.ceil(near("_s1")) + 1, F.lit(n - 1))
    points = F.when(F.col("_all") <= 0, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.sequence(low.cast("int"), high.cast("int")))
    rows = rows.withColumn("point", F.explode(points))
    on = (F.col("_s") <= u(F.col("point"))) & ((u(F.col("point")) < F.col("_s1")) | ((F.col("point") == n - 1) & (F.col("_s1") == F.col("_all"))))
    rows = rows.where((F.col("_all") <= 0) | ((F.col("point") < n - 1) & on) | ((F.col("point") == n - 1) & (F.col("_s1") == F.col("_all"))))
    share = F.when(F.col("_all") <= 0, 0.0).otherwise((F.when(F.col("point") == n - 1, F.col("_all")).otherwise(u(F.col("point"))) - F.col("_s")) / (F.col("_s1") - F.col("_s")))
    at = lambda a, b: F.when(F.col("_all") <= 0, F.col(a)).otherwise(F.col(a) + share * (F.col(b) - F.col(a)))
    return rows.select(*key, F.col("point").cast("long").alias("point"), at(x, "_x1").alias("x"), at(y, "_y1").alias("y"))


def clean_polyline(df: DataFrame, key: list[str], order: list[str], n: int = 40) -> DataFrame:
    """Turned first, then resampled; no length: by index."""
    return resampled(oriented(df, key, order), key, ["pos"], n, by_index=True)


def feature_polyline(df: DataFrame, key: list[str], order: list[str], n: int = 20) -> DataFrame:
    """Resampled first, then turned; no length: the first point."""
    out = resampled(df, key, order, n, by_index=False)
    ends = W.partitionBy(*key)
    turned = F.max(F.when(F.col("point") == 0, F.col("x"))).over(ends) < F.max(F.when(F.col("point") == n - 1, F.col("x"))).over(ends)
    return out.withColumn("point", F.when(turned, n - 1 - F.col("point")).otherwise(F.col("point")))


def gap_clusters(df: DataFrame, key: list[str], order: list[str], distance: Column, gap: float) -> DataFrame:
    """Adds ``cluster``: a new one begins where the distance to the last row exceeds the gap."""
    return df.withColumn("_new", F.when(distance > gap, 1).otherwise(0)).withColumn("cluster", F.sum("_new").over(_upto(key, order))).drop("_new")


def largest_cluster(df: DataFrame, key: list[str], order: list[str], distance: Column, gap: float = 50.0) -> DataFrame:
    """Rows of the longest run without a gap; the first of equals."""
    runs = gap_clusters(df, key, order, distance, gap).withColumn("_n", F.count("*").over(W.partitionBy(*key, "cluster")))
    best = F.max(F.struct("_n", -F.col("cluster"))).over(W.partitionBy(*key))
    return runs.withColumn("_best", best).where((F.col("_best._n") == F.col("_n")) & (-F.col("_best.col2") == F.col("cluster"))).drop("_n", "_best")


def interpolated(df: DataFrame, key: list[str], order: list[str], value: str, to: str) -> DataFrame:
    """Fills nulls on the straight line between the known neighbours, by row position; ends repeat the nearest."""
    w = W.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("_p", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(value).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("_a", before).withColumn("_b", after)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_p") - F.col("_a.p")) / F.nullif(F.col("_b.p") - F.col("_a.p"), F.lit(0))
    return rows.withColumn(to, F.coalesce(F.col(value), line, F.col("_a.v"), F.col("_b.v"))).drop("_p", "_a", "_b")


@lru_cache(maxsize=64)
def savgol_weights(window: int, degree: int) -> tuple[tuple[float, ...], ...]:
    """Row i: weights of a window's values in the fitted polynomial at its i-th place."""
    v = np.vander(np.arange(window) - window // 2, degree + 1, increasing=True).astype(float)
    return tuple(map(tuple, (v @ np.linalg.pinv(v)).tolist()))


def savgol(df: DataFrame, key: list[str], order: list[str], value: str, to: str, degree: int, least: int, most: int = 31) -> DataFrame:
    """Savitzky-Golay smoothing; ends take the polynomial of the first or last full window.

    Short series use the largest odd window that they hold, and stay as they
    are below ``least`` rows to a window. The window is a slice of neighbours
    around each row, weighted by a constant matrix: one sort of the series,
    nothing joined.
    """
    w = W.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("_n", F.count("*").over(W.partitionBy(*key))).withColumn("_i", F.row_number().over(w) - 1)
    rows = rows.withColumn("_w", odd_window(F.col("_n"), most).cast("int"))
    # 2 * most neighbours hold every window of a row, wherever it is clamped.
    rows = rows.withColumn("_near", F.collect_list(value).over(w.rowsBetween(-(most - 1), most - 1)))
    start = F.greatest(F.lit(0), F.least(F.col("_i") - F.floor(F.col("_w") / 2), F.col("_n") - F.col("_w")))
    first = F.greatest(F.lit(0), F.col("_i") - (most - 1))
    rows = rows.withColumn("_start", start.cast("int")).withColumn("_taken", F.slice("_near", (F.col("_start") - first + 1).cast("int"), F.greatest("_w", F.lit(1))))
    sizes = [k for k in range(1, most + 1, 2) if k >= max(least, degree + 1)]
    weights = None
    for k in sizes:
        table = F.from_json(F.lit(str([list(r) for r in savgol_weights(k, degree)])), "array<array<double>>")
        own = F.get(table, (F.col("_i") - F.col("_start")).cast("int"))
        weights = F.when(F.col("_w") == k, own) if weights is None else weights.when(F.col("_w") == k, own)
    smooth = F.aggregate(F.zip_with("_taken", "_weights", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumn("_weights", weights)
    return rows.withColumn(to, F.when(F.col("_weights").isNotNull(), smooth).otherwise(F.col(value).cast("double"))).drop("_n", "_i", "_w", "_near", "_start", "_taken", "_weights")


class _Along:
    """One series of vectors, read in order: fills those that are missing, smooths, and holds only rows that later ones still change."""

    def __init__(self, degree: int, least: int, most: int) -> None:
        self.degree, self.least, self.most = degree, max(least, degree + 1), most
        self.n = self.given = self.first = 0  # rows seen, rows given out, place of the first one held
        self.held: np.ndarray | None = None  # filled rows from ``first`` on
        self.known: np.ndarray | None = None  # the last vector that was there

    def add(self, rows: np.ndarray, there: np.ndarray) -> None:
        """Rows (n x width); those not ``there`` wait for the next that is."""
        at = np.flatnonzero(there)
        base, self.n = self.n, self.n + len(rows)
        if not len(at):
            return
        ends = rows[at] if self.known is None else np.vstack([self.known, rows[at]])
        done = self.first + (0 if self.held is None else len(self.held))
        places = at + base if self.known is None else np.concatenate([[done - 1], at + base])
        todo = np.arange(done, places[-1] + 1)
        after = np.searchsorted(places, todo)
        before = np.where(places[after] == todo, after, after - 1)
        a, b = ends[np.maximum(before, 0)], ends[after]  # rows before the first known one repeat it
        a = np.where((before < 0)[:, None], b, a)
        gap = np.where((before == after) | (before < 0), 1, places[after] - places[np.maximum(before, 0)])
        way = np.where((before == after) | (before < 0), 0, todo - places[np.maximum(before, 0)])
        fresh = a + (b - a) * way[:, None] / gap[:, None]
        self.held = fresh if self.held is None else np.vstack([self.held, fresh])
        self.known = rows[at[-1]]

    def give(self, ended: bool = False) -> tuple[int, np.ndarray | None, np.ndarray | None]:
        """The next rows that are final: how many, filled, smoothed (no vectors if the whole series has none)."""
        if self.held is None:
            return (self.n if ended else 0), None, None
        have = self.first + len(self.held)
        if ended and have < self.n:  # the end repeats the last known vector
            self.held = np.vstack([self.held, np.repeat(self.known[None], self.n - have, axis=0)])
            have = self.n
        to = self.n if ended else (have - self.most // 2 if have >= self.most else 0)
        i = np.arange(self.given, max(to, self.given))
        if not len(i):
            return 0, None, None
        window = min(self.most, self.n - (1 - self.n % 2)) if ended else self.most
        own = self.held[i - self.first]
        if window < self.least:
            smooth = own
        else:
            start = np.clip(i - window // 2, 0, self.n - window if ended else None)
            weights, smooth = np.array(savgol_weights(window, self.degree)), np.zeros_like(own)
            middle = np.flatnonzero(i - start == window // 2)  # one run of rows, whose windows move on with them
            a, b = (int(middle[0]), int(middle[-1]) + 1) if len(middle) else (0, 0)
            ends = np.r_[0:a, b : len(i)]
            for j in range(window):
                if b > a:
                    at = int(start[a]) + j - self.first
                    smooth[a:b] += self.held[at : at + b - a] * weights[window // 2, j]
                if len(ends):
                    smooth[ends] += self.held[start[ends] + j - self.first] * weights[i[ends] - start[ends], j, None]
        self.given = int(i[-1]) + 1
        keep = max(self.first, self.given - self.most)
        self.held, self.first = self.held[keep - self.first :], keep
        return len(i), own, smooth


def smoothed_frames(df: DataFrame, key: list[str], order: str, columns: list[str], degree: int, least: int, most: int = 31, points: int | None = None) -> DataFrame:
    """Arrays of one length a frame, each place a series over the frames: filled as by ``interpolated``, smoothed as by ``savgol``.

    Returns key, order, and for each column itself and ``<column>_smooth``. A frame's arrays are all there or all null. The
    frames of a key are a sorted stream; a task holds those that the next ones still change, not the series. With ``points``,
    the two columns are curves of any number of points, taken at so many of equal arc length as they stream by.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in [*key, order]), *(f"`{c}` array<double>" for c in [*columns, *(f"{c}_smooth" for c in columns)])])
    rows = df.select(*key, order, *columns).repartition(*key).sortWithinPartitions(*key, order)

    def arrays(values: np.ndarray | None, n: int, width: int) -> list[pa.Array]:
        if values is None:
            return [pa.nulls(n, pa.list_(pa.float64()))] * len(columns)
        flat = [np.ascontiguousarray(values[:, i * width : (i + 1) * width]).ravel() for i in range(len(columns))]
        return [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(v)) for v in flat]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        along, name, waiting = None, None, []

        def given(ended: bool) -> Iterator[pa.RecordBatch]:
            """Owners (key and order) wait beside their vectors."""
            nonlocal waiting
            n, own, smooth = along.give(ended)
            if n:
                owners = pa.Table.from_batches(waiting).combine_chunks()
                width = 0 if own is None else own.shape[1] // len(columns)
                out = owners.slice(0, n).to_batches()[0]
                waiting = owners.slice(n).to_batches()
                yield pa.RecordBatch.from_arrays([*out.columns, *arrays(own, n, width), *arrays(smooth, n, width)], [*key, order, *columns, *(f"{c}_smooth" for c in columns)])

        for part in parts:
            if not part.num_rows:
                continue
            owners = part.select([*key, order])
            there = part[columns[0]].is_valid().to_numpy(zero_copy_only=False)
            values = np.zeros((part.num_rows, 0))
            if points:
                there, values = _evened(*(part[c] for c in columns), points)
            elif there.any():
                flat = np.hstack([part[c].flatten().to_numpy(zero_copy_only=False).reshape(int(there.sum()), -1) for c in columns])
                values = np.zeros((part.num_rows, flat.shape[1]))
                values[there] = flat
            names = list(zip(*(part[k].to_pylist() for k in key)))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if name is None or names[a] != name:
                    if name is not None:
                        yield from given(True)
                    along, name, waiting = _Along(degree, least, most), names[a], []
                along.add(values[a:b], there[a:b])
                waiting.append(owners.slice(a, b - a))
                if b == len(names):
                    yield from given(False)
        if name is not None:
            yield from given(True)

    return rows.mapInArrow(run, schema)


def _even(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of curves (each a row of x and one of y) at n points of equal arc length; no length: the first point."""
    rows, last = np.arange(len(x))[:, None], x.shape[1] - 1
    arc = np.hstack([np.zeros((len(x), 1)), np.cumsum(np.hypot(np.diff(x), np.diff(y)), axis=1)])
    total = arc[:, -1:]
    at = np.hstack([total * np.arange(n - 1) / (n - 1), total])
    segment = np.zeros(at.shape, int)
    for i in range(1, last):
        segment += arc[:, i, None] <= at
    segment[:, -1] = np.maximum((arc == total).argmax(axis=1) - 1, 0)  # the end lies on the first segment that reaches it
    s, s1 = arc[rows, segment], arc[rows, segment + 1]
    share = np.where(total > 0, (at - s) / np.where(s1 > s, s1 - s, 1.0), 0.0)
    fx, fy = (np.where(total > 0, v[rows, segment] + share * (v[rows, segment + 1] - v[rows, segment]), v[:, :1]) for v in (x, y))
    return fx, fy


def _evened(x: pa.ListArray, y: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Curves of any number of points: which have a way to follow, and their rows of n x and n y. Those of one point, of none, or with a length that is not finite have none."""
    sizes = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    flat = [v.flatten().to_numpy(zero_copy_only=False) for v in (x, y)]
    there, values = np.zeros(len(x), bool), np.zeros((len(x), 2 * n))
    for m in np.unique(sizes[sizes > 1]):
        some = np.flatnonzero(sizes == m)
        for at in np.array_split(some, len(some) * int(m) // 1_000_000 + 1):
            own = [v[starts[at][:, None] + np.arange(m)] for v in flat]
            with np.errstate(all="ignore"):
                there[at] = np.isfinite(np.hypot(*map(np.diff, own)).sum(axis=1) * (n - 2))
                values[at] = np.hstack(_even(*own, n))
    return there, values


def feature_frames(df: DataFrame, key: list[str], x: str, y: str, n: int = 20) -> DataFrame:
    """As ``feature_polyline`` for curves of one number of points held as arrays, a row each: key, x, y."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "x array<double>", "y array<double>"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 2_000):
                some = part.slice(i, 2_000)
                got = _even(*(some[c].flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1) for c in (x, y)), n)
                turn = (got[0][:, 0] < got[0][:, -1])[:, None]  # from larger to smaller x
                got = [np.where(turn, v[:, ::-1], v) for v in got]
                places = pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays([*(some[k] for k in key), *(pa.ListArray.from_arrays(places, pa.array(np.ascontiguousarray(v).ravel())) for v in got)], [*key, "x", "y"])

    return df.select(*key, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).mapInArrow(run, schema)


def gradient(df: DataFrame, key: list[str], order: list[str], value: str, to: str) -> DataFrame:
    """Central differences; one-sided at the ends; null for a single row."""
    w = W.partitionBy(*key).orderBy(*order)
    before, after, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return df.withColumn(to, F.coalesce((after - before) / 2, after - own, own - before))


def with_totals(df: DataFrame, key: list[str], totals: dict[str, Column]) -> DataFrame:
    """Adds aggregates over the key by a grouping, which combines per task, and a join: keys may hold any share of the rows."""
    found = df.groupBy(*key).agg(*(c.alias(n) for n, c in totals.items()))
    found = found.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(key)), *totals)
    same = [df[k].eqNullSafe(found[f"_key{i}"]) for i, k in enumerate(key)]
    return df.join(found, reduce(lambda x, y: x & y, same)).drop(*(f"_key{i}" for i in range(len(key))))


def scaled_coords(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Each column to [0, 1] over the whole of its key; a constant column stays as it is."""
    names = df.columns
    df = with_totals(df, key, {f"_{f.__name__}{i}": f(c) for i, c in enumerate(columns) for f in (F.min, F.max)})
    for i, c in enumerate(columns):
        low, high = F.col(f"_min{i}"), F.col(f"_max{i}")
        df = df.withColumn(c, F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.col(c)))
    return df.select(*names)


def scaled_intensity(df: DataFrame, key: list[str], value: str, to: str) -> DataFrame:
    """A value to [0, 1] over the whole of its key; a constant becomes 0."""
    df = with_totals(df, key, {"_low": F.min(value), "_high": F.max(value)})
    return df.withColumn(to, F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.lit(0.0))).drop("_low", "_high")


def baseline_removed(df: DataFrame, key: list[str], order: list[str], value: str, to: str, rows: int = 5) -> DataFrame:
    """Less the mean of the first rows of the series."""
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    base = F.avg(F.when(F.col("_r") <= rows, F.col(value))).over(W.partitionBy(*key))
    return ranked.withColumn(to, F.col(value) - base).drop("_r")


def outlier_gate(df: DataFrame, key: list[str], columns: list[str], sigmas: float = 2.0) -> DataFrame:
    """Adds ``outlier``: some column lies more than so many population deviations from its mean."""
    names, out = df.columns, F.lit(False)
    df = with_totals(df, key, {f"_{n}{i}": f(c) for i, c in enumerate(columns) for n, f in (("mean", F.avg), ("spread", F.stddev_pop))})
    for i, c in enumerate(columns):
        out = out | (F.abs(F.col(c) - F.col(f"_mean{i}")) > sigmas * F.col(f"_spread{i}"))
    return df.select(*names, F.coalesce(out, F.lit(False)).alias("outlier"))


def anchored(df: DataFrame, key: list[str], order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Each curve moved so that its right-most end lies at the origin; of ends level with each other, the first."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.first(x).over(w) >= F.last(x).over(w)
    ends = {c: F.when(first, F.first(c).over(w)).otherwise(F.last(c).over(w)) for c in (x, y)}
    moved = df.withColumn("_x", F.col(x) - ends[x]).withColumn("_y", F.col(y) - ends[y])
    return moved.withColumn(x, F.col("_x")).withColumn(y, F.col("_y")).drop("_x", "_y")


def head_tail_split(df: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """Adds ``split``: the first eight tenths train, the rest from 8.25 tenths on tests, between them neither."""
    if key:
        rows = df.withColumn("_i", F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*key)))
    else:
        rows = positioned(df, order, "_i", "_n")
    train, test = F.floor(F.col("_n") / 10) * 8, F.floor(F.col("_n") / 10 * 8.25)
    return rows.withColumn("split", F.when(F.col("_i") < train, "train").when(F.col("_i") >= test, "test")).drop("_i", "_n")
