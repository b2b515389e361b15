"""Order-dependent selections against plain loops, in many rounds, batches and keys, and at size."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.functions.plane import Leaders
from seriesforge.operators import circles, diverse

VECTORS = "g string, i long, v array<double>, _dim int"


def plain_unique(rows, least):
    kept = {}
    out = []
    for g, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        odd = v is None or not v or any(x is None for x in v)
        if odd or all(len(w) != len(v) or sum(abs(a - b) for a, b in zip(v, w)) / len(v) > least for w in kept.get(g, ())):
            out.append((g, i))
            if not odd:
                kept.setdefault(g, []).append(v)
    return sorted(map(repr, out))


def drifting(n, dim, seed):
    rnd = np.random.default_rng(seed)
    return np.cumsum(rnd.normal(0, 0.01, (n, dim)), axis=0).tolist()


@pytest.mark.parametrize(("block", "most"), [(2048, 32 << 20), (16, 32 << 20), (16, 600), (3, 1)])
def test_kept_in_order_equals_plain_loop(spark, monkeypatch, block, most):
    monkeypatch.setattr(diverse, "MOST_BYTES", most)
    rows = [("a", i, v) for i, v in enumerate(drifting(70, 3, 1))] + [("b", i, v) for i, v in enumerate(drifting(40, 3, 2))] + [(None, i, v) for i, v in enumerate(drifting(9, 3, 3))]
    rows += [("a", 100, None), ("a", 101, []), ("a", 102, [1.0, None, 2.0]), ("a", 103, [0.0, 0.0]), ("a", 104, [0.0, 0.001]), ("c", 1, [1.0])]
    df = spark.createDataFrame([(*r, 9) for r in rows], VECTORS).drop("_dim").repartition(5)
    got = diverse.kept_in_order(df, ["g"], ["i"], "v", 0.02, block).collect()
    assert sorted(repr((r.g, r.i)) for r in got) == plain_unique(rows, 0.02)
    assert diverse.kept_in_order(df.limit(0), ["g"], ["i"], "v", 0.02, block).count() == 0


def test_rounds_on_a_drifting_trajectory_are_bounded(spark, monkeypatch):
    rounds, one = [], diverse._block
    monkeypatch.setattr(diverse, "_block", lambda *a: rounds.append(1) or one(*a))
    v = drifting(10_000, 8, 4)
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "g string, i long, v array<double>")
    got = sorted(r.i for r in diverse.kept_in_order(df, ["g"], ["i"], "v", 0.02).collect())
    assert len(rounds) <= 10_000 // (diverse.BLOCK - diverse.BUCKET) + 2
    columns = np.array(v).T.copy()
    assert got == np.flatnonzero(diverse.folded(columns, 0.02)).tolist()


def plain_clusters(rows, centre=18.0, radius=14.0):
    out = []
    for x, y, r, f in rows:
        for c in out:
            n, sx, sy, sr, seen = c
            if ((x - sx / n) ** 2 + (y - sy / n) ** 2) ** 0.5 <= centre and abs(r - sr / n) <= radius:
                c[:] = [n + 1, sx + x, sy + y, sr + r, seen | {f}]
                break
        else:
            out.append([1, x, y, r, {f}])
    return [(i, round(sx / n, 9), round(sy / n, 9), round(sr / n, 9), n, len(seen)) for i, (n, sx, sy, sr, seen) in enumerate(out)]


def detections(n, seed, size=400):
    rnd = random.Random(seed)
    return [(rnd.uniform(-size, size), rnd.uniform(-size, size), rnd.uniform(10, 60), rnd.randrange(12)) for _ in range(n)]


def test_leader_clusters_equal_plain_loop(spark):
    a, b = detections(800, 1), detections(300, 2, 60)
    rows = [(g, i, *d) for g, ds in (("a", a), (None, b)) for i, d in enumerate(ds)] + [("a", 5000, None, 1.0, 1.0, 1), ("b", 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "g string, o long, x double, y double, r double, frame long").repartition(6)
    got = circles.leader_clusters(df, ["g"], "o").collect()
    for g, ds in (("a", a), (None, b)):
        own = sorted((r.cluster, round(r.x, 9), round(r.y, 9), round(r.r, 9), r.n, r.support) for r in got if r.g == g)
        assert own == plain_clusters(ds)
    assert {r.g for r in got} == {"a", None}
    assert circles.leader_clusters(df.limit(0), ["g"], "o").count() == 0


def test_leader_clusters_of_one_long_recording(spark):
    """100,000 detections of one recording, which has as many clusters as there is room for, in near linear time."""
    took = []
    for n in (25_000, 100_000):
        ds = detections(n, 3)
        began, held = time.perf_counter(), Leaders(18.0, 14.0)
        for x, y, r, _ in ds:
            held.take(x, y, r)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]
    df = spark.createDataFrame([("a", i, *d) for i, d in enumerate(ds)], "g string, o long, x double, y double, r double, frame long")
    got = circles.leader_clusters(df, ["g"], "o")
    assert got.agg(F.sum("n"), F.count("*")).first() == (100_000, len(held.sums))


@pytest.mark.parametrize("factor", [0.4, 1.5, 30.0])
def test_non_overlapping_equals_plain_loop(spark, factor):
    rows = [(g, i, x, y, r) for g in ("a", "b") for i, (x, y, r, _) in enumerate(detections(400, 4 if g == "a" else 5, 150))]
    df = spark.createDataFrame(rows, "g string, cluster long, x double, y double, r double").repartition(3)
    want = []
    for g in ("a", "b"):
        kept = []
        for row in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[4], r[1])):
            if all(((row[2] - k[2]) ** 2 + (row[3] - k[3]) ** 2) ** 0.5 >= factor * min(row[4], k[4]) for k in kept):
                kept.append(row)
        want += [(g, r[1]) for r in kept]
    got = circles.non_overlapping(df, ["g"], [-F.col("r")], factor).collect()
    assert sorted((r.g, r.cluster) for r in got) == sorted(want)


def test_separated_stops_at_most(spark):
    df = spark.createDataFrame([("a", i, float(10 * i), 0.0, 5.0, 15.0, 3) for i in range(20)], "g string, cluster long, x double, y double, r double, gap double, most int")
    got = circles.separated(df, ["g"], [F.col("cluster")], "gap", "most").collect()
    assert sorted(r.cluster for r in got) == [0, 2, 4]
