"""Circles found in frames: clustering, selection, refinement, tracking.

Order-dependent steps read the detections of a recording as a sorted stream;
what a task holds is the clusters, or the circles kept, of one recording, in
cells of the plane, so a detection is compared with those around it alone.
Recordings run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesforge.functions.plane import Apart, Leaders
from seriesforge.functions.quantiles import exact_quantiles, with_key_values
from seriesforge.functions.staging import staged


def stable_order(df: DataFrame, key: list[str], tie: list[str]) -> DataFrame:
    """Adds ``circle``: numbers by row, then column, of the truncated centre."""
    w = W.partitionBy(*key).orderBy(F.col("y").cast("int"), F.col("x").cast("int"), *tie)
    return df.withColumn("circle", (F.row_number().over(w) - 1).cast("long"))


def leader_clusters(df: DataFrame, key: list[str], order: str, centre: float = 18.0, radius: float = 14.0, seen: str = "frame") -> DataFrame:
    """Each detection joins the first cluster whose running mean is near enough, or founds one.

    Returns key, cluster, x, y, r (means), n, support (distinct values of ``seen``, nulls apart).
    Detections without a centre or a radius are none. Recordings run side by side, each as a
    sorted stream: a task holds the clusters of one recording, not its detections.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name in key}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "cluster long", "f long", "n long", "x double", "y double", "r double"])
    rows = df.select(*key, F.col(order).alias("_o"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "r")), F.col(seen).cast("long").alias("f")).dropna(subset=["x", "y", "r"])
    rows = rows.repartition(*key) if key else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*key, "_o", "x", "y", "r", "f")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, name = Leaders(centre, radius), None, None
        for part in parts:
            owner = list(zip(*(part[k].to_pylist() for k in key))) if key else [()] * part.num_rows
            joined = []
            for i, (who, x, y, r) in enumerate(zip(owner, *(part[c].to_pylist() for c in ("x", "y", "r")))):
                if name is None or who != name:
                    if name is not None:
                        yield held.rows(of, key)
                    held, of, name = Leaders(centre, radius), part.slice(i, 1), who
                joined.append(held.take(x, y, r))
            none = [pa.nulls(part.num_rows, t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*(part[k] for k in key), pa.array(joined, pa.int64()), part["f"], *none], [*key, "cluster", "f", "n", "x", "y", "r"])
        if name is not None:
            yield held.rows(of, key)

    out = rows.mapInArrow(run, schema)
    # A row for each detection, a row with the means for each cluster: frames are counted where they are grouped.
    out = out.groupBy(*key, "cluster", "f").agg(*(F.max(c).alias(c) for c in ("n", "x", "y", "r")))
    return out.groupBy(*key, "cluster").agg(*(F.max(c).alias(c) for c in ("x", "y", "r", "n")), F.count("f").alias("support"))


def non_overlapping(df: DataFrame, key: list[str], rank: list[Column], factor: float) -> DataFrame:
    """In rank order, circles whose centre keeps ``factor`` times the smaller radius from all kept ones."""
    return _greedy(df, key, rank, factor=factor)


def separated(df: DataFrame, key: list[str], rank: list[Column], distance: str, most: str) -> DataFrame:
    """In rank order, circles at least ``distance`` (a column) from all kept ones, until ``most`` are kept."""
    return _greedy(df, key, rank, gap=distance, most=most)


def _greedy(df: DataFrame, key: list[str], rank: list[Column], factor: float | None = None, gap: str | None = None, most: str | None = None) -> DataFrame:
    """A sorted stream for each key; a task holds the circles kept of one key, by place."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name in [*key, "cluster"]}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in [*key, "cluster"]), "x double", "y double", "r double"])
    ranks = [c.alias(f"_k{i}") for i, c in enumerate(rank)]
    rows = df.select(*key, *ranks, "cluster", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "r")), (F.col(gap).cast("double") if gap else F.lit(0.0)).alias("_gap"), (F.col(most) if most else F.lit(2**31 - 1)).cast("long").alias("_most"))
    rows = rows.dropna(subset=["x", "y", "r"])
    rows = rows.repartition(*key) if key else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*key, *(f"_k{i}" for i in range(len(rank))), "cluster", "x", "y", "r", "_gap")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = Apart(factor), None
        for part in parts:
            owner = list(zip(*(part[k].to_pylist() for k in key))) if key else [()] * part.num_rows
            keep = []
            for who, x, y, r, space, limit in zip(owner, *(part[c].to_pylist() for c in ("x", "y", "r", "_gap", "_most"))):
                if name is None or who != name:
                    held, name = Apart(factor), who
                keep.append(len(held.kept) < limit and held.take(x, y, r, space))
            yield part.filter(pa.array(keep, pa.bool_())).select([*key, "cluster", "x", "y", "r"])

    return rows.mapInArrow(run, schema)


def least_support(frames: Column, share: float = 0.07, low: int = 8, high: int = 40) -> Column:
    """Frames in which a cluster must be seen, of so many sampled ones."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.ceil(frames * share)))


def temporal_selection(clusters: DataFrame, key: list[str], frames: str, low: int = 8) -> DataFrame:
    """Well supported clusters of like radius that do not overlap, best first."""
    enough = clusters.where(F.col("support") >= least_support(F.col(frames), low=low))
    w = W.partitionBy(*key)
    ranked = enough.withColumn("_k", F.row_number().over(w.orderBy(F.col("support").desc(), F.col("r").desc(), "cluster")))
    reference = F.median(F.when(F.col("_k") <= 12, F.col("r"))).over(w)
    band = ranked.withColumn("_ref", reference).where("r between 0.70D * _ref and 1.30D * _ref")
    return non_overlapping(band, key, [F.col("_k")], 0.80)


def layout_selection(clusters: DataFrame, key: list[str], frames: str, target: str, low: int = 8) -> DataFrame:
    """Exactly ``target`` circles of one radius, well apart, best score first; none if no spacing gives them.

    Clusters bring support, evidence_p90 and evidence_median.
    """
    w = W.partitionBy(*key)
    rows = clusters.withColumn("_ref", F.median(F.when(F.col("support") >= F.col(frames) * 0.55, F.col("r"))).over(w)).where("_ref > 0")
    rows = rows.where((F.col("support") >= F.greatest(F.lit(low), F.ceil(F.col(frames) * 0.04))) & F.expr("r between 0.78D * _ref and 1.22D * _ref"))
    score = F.log1p("support") + 0.08 * F.col("evidence_p90") + 0.03 * F.col("evidence_median") - 0.6 * F.abs(F.col("r") - F.col("_ref")) / F.col("_ref")
    rows = rows.withColumn("_score", F.round(score, 9)).withColumn("_f", F.explode(F.array(*(F.lit(f) for f in (1.85, 1.70, 1.55, 1.40)))))
    rows = rows.withColumn("_gap", F.col("_f") * F.col("_ref"))
    kept = separated(rows, [*key, "_f", "_ref", target], [-F.col("_score"), F.col("cluster")], "_gap", target)
    n = F.count("*").over(W.partitionBy(*key, "_f"))
    full = kept.withColumn("_n", n).where(F.col("_n") == F.col(target)).withColumn("_best", F.max("_f").over(w)).where("_f = _best")
    return full.select(*key, "cluster", "x", "y", F.col("_ref").alias("r"), F.col("_f").alias("factor"))


def _per_key(df: DataFrame, key: list[str], values: list[DataFrame], *more: Column) -> DataFrame:
    """One staged row for each key: ``_rows`` and further sums, and the values that other tables hold by key."""
    out = df.groupBy(*key).agg(F.count("*").alias("_rows"), *more)
    for v in values:
        named = v.select(*(F.col(k).alias(f"_v_{k}") for k in key), *(c for c in v.columns if c not in key))
        found = F.lit(True)
        for k in key:
            found = found & F.col(k).eqNullSafe(F.col(f"_v_{k}"))
        out = out.join(named, found, "left").drop(*(f"_v_{k}" for k in key))
    return staged(out)


def consensus_shift(df: DataFrame, key: list[str], most: float, inlier: float = 7.0) -> DataFrame:
    """The shift that most candidates (dx, dy) agree on, no longer than ``most``; zero without candidates.

    Medians are exact and no key's candidates meet in one task.
    """
    near = df.select(*key, "dx", "dy").where(F.hypot("dx", "dy") <= most)
    medians = lambda rows, x, y: [exact_quantiles(rows, key, "dx", {x: 0.5}), exact_quantiles(rows, key, "dy", {y: 0.5})]
    first = _per_key(df, key, medians(near, "_mx", "_my"))
    close = with_key_values(near, first, key, "_rows").where(F.hypot(F.col("dx") - F.col("_mx"), F.col("dy") - F.col("_my")) <= inlier).select(*key, "dx", "dy")
    out = _per_key(df, key, [*medians(close, "_cx", "_cy"), first.drop("_rows")])
    out = out.select(*key, F.coalesce("_cx", "_mx", F.lit(0.0)).alias("dx"), F.coalesce("_cy", "_my", F.lit(0.0)).alias("dy"))
    norm = F.hypot("dx", "dy")
    shrink = F.when(norm > most, most / norm).otherwise(1.0)
    return out.select(*key, (F.col("dx") * shrink).alias("dx"), (F.col("dy") * shrink).alias("dy"))


def tracked(df: DataFrame, key: list[str], order: str, alpha: float = 0.70) -> DataFrame:
    """Centres that follow each frame's shift: wholly at the first frame, by ``alpha`` later.

    Shifts add up, so a running sum says what the frame-by-frame loop would.
    """
    w = W.partitionBy(*key).orderBy(order)
    share = F.when(F.row_number().over(w) == 1, 1.0).otherwise(alpha)
    out = df.withColumn("_sx", F.col("dx") * share).withColumn("_sy", F.col("dy") * share)
    total = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return out.withColumn("cx", F.col("x0") + F.sum("_sx").over(total)).withColumn("cy", F.col("y0") + F.sum("_sy").over(total)).drop("_sx", "_sy")


def refined_radius(df: DataFrame, key: list[str], least: int = 5, floor: float = 70.0) -> DataFrame:
    """Median radius of the bright candidates of each circle, of all if few are bright, of none if there are few.

    Quantiles are exact and no circle's candidates meet in one task.
    """
    rows = df.select(*key, "brightness", "r", "r0")
    cuts = _per_key(rows, key, [exact_quantiles(rows, key, "brightness", {"_q": 0.7})])
    bright = F.col("brightness") >= F.greatest(F.lit(floor), F.col("_q"))
    rows = staged(with_key_values(rows, cuts, key, "_rows").select(*key, "r", "r0", F.coalesce(bright, F.lit(False)).alias("_bright")))
    medians = [exact_quantiles(rows.where("_bright"), key, "r", {"_b": 0.5}), exact_quantiles(rows, key, "r", {"_a": 0.5})]
    out = _per_key(rows, key, medians, F.sum(F.col("_bright").cast("long")).alias("bright"), F.min("r0").alias("r0")).withColumnRenamed("_rows", "n")
    r = F.when(F.col("n") < least, F.col("r0")).when(F.col("bright") >= least, F.col("_b")).otherwise(F.col("_a"))
    return out.select(*key, "n", "bright", r.alias("r"))


def stabilised_radii(df: DataFrame, key: list[str]) -> DataFrame:
    """Radii far from the upper half's median take that median; fewer than three stay. Medians are exact, no key meets in one task."""
    medians = _per_key(df, key, [exact_quantiles(df, key, "r", {"_m": 0.5})])
    upper = with_key_values(df.select(*key, "r"), medians, key, "_rows").where(F.col("r") >= F.col("_m"))
    told = _per_key(df, key, [medians.drop("_rows"), exact_quantiles(upper.select(*key, "r"), key, "r", {"_ref": 0.5})])
    rows = with_key_values(df, told, key, "_rows")
    out = ~F.expr("r between _ref * 0.70D and _ref * 1.30D")
    return rows.withColumn("r", F.when((F.col("_rows") >= 3) & (F.col("_m") > 0) & out, F.col("_ref")).otherwise(F.col("r"))).drop("_m", "_rows", "_ref")


def nearest_candidate(circles: DataFrame, candidates: DataFrame, key: list[str], gate: float, weight: float) -> DataFrame:
    """Per circle, the candidate within the gate of the lowest distance plus weighted change of radius.

    Candidates are looked up in the grid cells around the circle, so the join is one of equals.
    """
    cell = lambda c: F.floor(F.col(c) / gate)
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = circles.withColumn("_s", near).withColumn("_gx", cell("x") + F.col("_s.i")).withColumn("_gy", cell("y") + F.col("_s.j")).drop("_s")
    right = candidates.select(*key, F.col("candidate"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("r").alias("qr"), cell("x").alias("_gx"), cell("y").alias("_gy"))
    pairs = left.join(right, [*key, "_gx", "_gy"]).withColumn("_d", F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy"))).where(F.col("_d") <= gate)
    pairs = pairs.withColumn("score", F.col("_d") + weight * F.abs(F.col("r") - F.col("qr")))
    best = F.min_by(F.struct("candidate", "score"), F.struct("score", "candidate"))
    return pairs.groupBy(*key, "circle").agg(best.alias("b")).select(*key, "circle", "b.candidate", "b.score")


def arbitrated(preferred: list[DataFrame], key: list[str]) -> DataFrame:
    """Per key, the rows of the first of these tables that has any; ``choice`` tells which."""
    out = None
    for i, df in enumerate(preferred):
        rows = df.withColumn("choice", F.lit(i))
        out = rows if out is None else out.unionByName(rows.join(out.select(*key).distinct(), key, "left_anti"))
    return out
