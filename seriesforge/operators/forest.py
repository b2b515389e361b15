"""Regression forests with many outputs, grown level by level from histograms.

Features are cut at quantiles into a few bins, once. Then every level of all
trees is one pass over the rows: tasks send each row down the trees grown so
far and add its weight and its targets to histograms by tree, node, feature and
bin; histograms meet by tree and node, where the best cut is found for all
features and outputs together. What reaches the driver is one row for each open node.
A pass holds ``MOST_BYTES`` of histograms in a task; where all trees need more,
groups of trees take turns.

Rows count in a tree as often as a Poisson draw from their hash says, which is
a bootstrap without a shuffle. A cut must lower the summed squares of all
outputs and leave ``least`` weight on either side; of equal cuts the one of the
first feature, then the lowest, is taken. Rows without features or targets, or
with nulls in them, are not learned from; rows without features are predicted
null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.staging import new_path

#: Histograms that a task holds at once, in bytes.
MOST_BYTES = 64 << 20
#: Chances of a Poisson draw of mean one to be at most 0, 1, 2 and so on.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 12.0)])))


@dataclass
class Forest:
    """Trees by node: node i has children 2i and 2i + 1, the root is 1; a node without a cut is a leaf."""

    cuts: list[np.ndarray]  # of each feature
    feature: np.ndarray  # (trees, nodes), -1 for a leaf
    bin: np.ndarray  # rows up to this bin go left
    value: np.ndarray  # (trees, nodes, outputs)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows of features."""
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def nodes(self, tree: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node where each row stands after so many levels of a tree."""
        at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[tree, at]
            down = f >= 0
            at = np.where(down, 2 * at + (bins[rows, np.maximum(f, 0)] > self.bin[tree, at]), at)
        return at

    def predicted(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the leaves' values: (rows, outputs)."""
        bins, depth = self.binned(x), self.feature.shape[1].bit_length() - 2
        out = np.zeros((len(x), self.value.shape[2]))
        for t in range(len(self.feature)):
            out += self.value[t, self.nodes(t, bins, depth)]
        return out / len(self.feature)


def weights(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row counts in a tree."""
    h = hashes ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD6E8FEB86659FD93 & 2**64 - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return np.searchsorted(POISSON, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, side="right").astype(float)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def best_cut(hist: np.ndarray, least: float) -> tuple[int, float, int]:
    """The feature of the best cut of a node's histograms (features, bins, 1 + outputs), its gain, and the last bin on its left; -1 if none fits."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    whole = hist.sum(axis=1, keepdims=True)
    right = whole - left
    part = lambda s: (s[..., 1:] ** 2).sum(axis=-1) / np.maximum(s[..., 0], 1e-300)
    gain = np.where((left[..., 0] >= least) & (right[..., 0] >= least), part(left) + part(right) - part(whole), -np.inf)
    feature, at = np.unravel_index(int(np.argmax(np.round(gain, 9))), gain.shape)
    return (int(feature), float(gain[feature, at]), int(at)) if np.isfinite(gain[feature, at]) else (0, 0.0, -1)


def grown(df: DataFrame, vector: str, targets: list[str], trees: int = 100, depth: int = 5, bins: int = 32, least: float = 1.0, bag: bool = True, seed: int = 42) -> Forest:
    """A forest for all targets at once."""
    spark, outputs = df.sparkSession, len(targets)
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = df.select(x.alias("x"), F.array(*(F.col(t).cast("double") for t in targets)).alias("y"))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)) & ~F.exists("y", lambda v: v.isNull() | F.isnan(v)))
    ranks = [i / bins for i in range(1, bins)]
    asked = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", ranks, 100 * bins).alias("q"))
    cuts = [np.unique(r["q"]) for r in asked.orderBy("f").collect()]  # a row for each feature
    width, nodes = len(cuts), 1 << (depth + 1)
    forest = Forest(cuts, np.full((trees, nodes), -1), np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes, outputs)))
    if not width:
        return forest
    path = new_path(spark)

    def to_bins(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                found = forest.binned(_rows(part["x"], width))
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in found], pa.binary()), part["y"], part["h"]], ["b", "y", "h"])

    rows.withColumn("h", F.xxhash64("x", "y")).mapInArrow(to_bins, "b binary, y array<double>, h long").write.parquet(path)
    rows = spark.read.schema("b binary, y array<double>, h long").parquet(path)

    def histograms(level: int, some: range):
        first = 1 << level

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((len(some), first, width, bins, 1 + outputs))
            for part in parts:
                if not part.num_rows:
                    continue
                b = np.frombuffer(b"".join(part["b"].to_pylist()), np.uint8).reshape(-1, width)
                y = _rows(part["y"], outputs)
                h = part["h"].to_numpy().view(np.uint64)
                places = np.arange(width) * bins + b
                for i, t in enumerate(some):
                    w = weights(h, t, seed) if bag else np.ones(len(b))
                    at = forest.nodes(t, b, level) - first
                    own = np.flatnonzero((at >= 0) & (w > 0))  # leaves above this level stand below its first node
                    flat = (at[own, None] * width * bins + places[own]).ravel()
                    for k in range(1 + outputs):
                        v = w[own] if k == 0 else w[own] * y[own, k - 1]
                        held[i, ..., k] += np.bincount(flat, np.repeat(v, width), first * width * bins).reshape(first, width, bins)
            for i, t in enumerate(some):
                for n in np.flatnonzero(held[i, :, 0, :, 0].sum(axis=1) > 0):
                    columns = [pa.array([t], pa.int32()), pa.array([int(n) + first], pa.int32()), pa.array([held[i, n].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "hist"])

        return run

    def cut(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, bins, 1 + outputs))
        for part in parts:
            for raw in part["hist"].to_pylist():
                total += np.frombuffer(raw).reshape(total.shape)
        f, gain, at = best_cut(total, least)
        left, whole = total[f, : at + 1].sum(axis=0), total[f].sum(axis=0)
        lists = [pa.array([s.tolist()], pa.list_(pa.float64())) for s in (left, whole)]
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.int32()) for k in key), pa.array([f], pa.int32()), pa.array([gain]), pa.array([at], pa.int32()), *lists], ["tree", "node", "f", "gain", "at", "left", "whole"])

    schema = "tree int, node int, f int, gain double, at int, left array<double>, whole array<double>"
    for level in range(depth):
        group = max(1, MOST_BYTES // ((1 << level) * width * bins * (1 + outputs) * 8))
        for begin in range(0, trees, group):
            some = range(begin, min(trees, begin + group))
            found = rows.mapInArrow(histograms(level, some), "tree int, node int, hist binary")
            for b in found.groupBy("tree", "node").applyInArrow(cut, schema).collect():  # a row for each open node
                t, n = b["tree"], b["node"]
                left, whole = np.array(b["left"]), np.array(b["whole"])
                if level == 0:
                    forest.value[t, n] = whole[1:] / whole[0]
                if b["at"] >= 0 and b["gain"] > 1e-9:
                    right = whole - left
                    forest.feature[t, n], forest.bin[t, n] = b["f"], b["at"]
                    forest.value[t, 2 * n], forest.value[t, 2 * n + 1] = left[1:] / left[0], right[1:] / right[0]
    return forest


def predictions(df: DataFrame, vector: str, targets: list[str], forest: Forest) -> DataFrame:
    """``df`` with ``<target>_predicted`` for every target."""
    shared, width = df.sparkSession.sparkContext.broadcast(forest), len(forest.cuts)  # trees * nodes * outputs numbers

    @F.pandas_udf("array<double>")
    def predict(vectors):
        import pandas as pd

        fits = vectors.map(lambda v: v is not None and len(v) == width and width > 0 and not any(x is None or x != x for x in v)).to_numpy(bool)
        out: list = [None] * len(vectors)
        if fits.any():
            for i, p in zip(np.flatnonzero(fits), shared.value.predicted(np.array(vectors[fits].tolist(), float))):
                out[i] = p
        return pd.Series(out, dtype=object)

    held = df.withColumn("_p", predict(F.transform(F.col(vector), lambda v: v.cast("double"))))
    return held.withColumns({f"{t}_predicted": F.get("_p", F.lit(i)) for i, t in enumerate(targets)}).drop("_p")
