"""Exact quantiles and lookups with keys that hold most rows, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.functions import quantiles
from seriesforge.functions.staging import staged
from seriesforge.operators import circles


def values(seed):
    rnd = random.Random(seed)
    rows = [("hot", rnd.choice([rnd.random(), 5.0, 7.0])) for _ in range(3000)]
    rows += [(f"k{rnd.randrange(40)}", round(rnd.gauss(0, 3), 1)) for _ in range(600)] + [(None, float(i)) for i in range(7)] + [("one", 3.0), ("none", None)]
    return rows


def test_quantiles_equal_numpy(spark):
    rows = values(1)
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: (r.a, r.b, r.c) for r in quantiles.exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.7, "c": 0.0}).collect()}
    for k in {k for k, v in rows if v is not None}:
        own = [v for x, v in rows if x == k and v is not None]
        assert got[k] == pytest.approx(tuple(np.quantile(own, [0.5, 0.7, 0.0])), abs=1e-12)
    assert "none" not in got
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", {"a": 0.5}).count() == 0


def test_lookups_of_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HOT_ROWS", 100)
    df = spark.createDataFrame(values(2), "k string, v double")
    per = staged(df.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m")))
    out = quantiles.with_key_values(df, per, ["k"], "n")
    assert out.count() == df.count() and out.columns == ["k", "v", "n", "m"]
    assert out.where("n = 3000").count() == 3000 and out.where("k is null and m = 6").count() == 7


@pytest.mark.parametrize("hot", [10**9, 50])
def test_radii_and_shifts_with_a_key_of_half_the_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(quantiles, "HOT_ROWS", hot)
    rnd = random.Random(3)
    rows = [(rnd.choice([0, 0, 0, 1, 2, 3, None]), float(rnd.randrange(40)), float(rnd.randrange(160)), 33.0, rnd.uniform(-30, 30), rnd.uniform(-30, 30)) for _ in range(1500)]
    df = spark.createDataFrame(rows, "k long, r double, brightness double, r0 double, dx double, dy double").repartition(5)
    radius = {r.k: r for r in circles.refined_radius(df, ["k"]).collect()}
    shift = {r.k: r for r in circles.consensus_shift(df, ["k"], 22.0).collect()}
    steady = circles.stabilised_radii(df, ["k"]).collect()
    assert len(steady) == len(rows)
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        cut = max(70.0, np.quantile([r[2] for r in own], 0.7))
        bright = [r[1] for r in own if r[2] >= cut]
        assert (radius[k].n, radius[k].bright) == (len(own), len(bright))
        assert radius[k].r == pytest.approx(np.median(bright if len(bright) >= 5 else [r[1] for r in own]))
        near = np.array([r[4:] for r in own if np.hypot(*r[4:]) <= 22.0])
        middle = np.median(near, axis=0)
        close = near[np.hypot(*(near - middle).T) <= 7.0]
        want = np.median(close, axis=0) if len(close) else middle
        assert (shift[k].dx, shift[k].dy) == pytest.approx(tuple(want))
        m = np.median([r[1] for r in own])
        ref = np.median([r[1] for r in own if r[1] >= m])
        assert sorted(r.r for r in steady if r.k == k) == pytest.approx(sorted(ref if not ref * 0.7 <= r[1] <= ref * 1.3 else r[1] for r in own))
