"""Series operators against numpy and pandas on small fixtures."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesforge.operators import series as s
from seriesforge.operators import tables
from seriesforge.plans import prepare

KEY, ORDER = ["g"], ["i"]


def frame(spark, groups):
    rows = [(g, i, *map(lambda v: None if v is None else float(v), p)) for g, points in groups.items() for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "g string, i long, x double, y double")


def polyline(x, y, n, by_index):
    step = np.hypot(np.diff(x), np.diff(y))
    at = np.r_[0, np.cumsum(step)]
    if at[-1] <= 0:
        if not by_index:
            return np.full(n, x[0]), np.full(n, y[0])
        at = np.arange(len(x), dtype=float)
    u = np.linspace(0, at[-1], n)
    return np.interp(u, at, x), np.interp(u, at, y)


GROUPS = {
    "down": [(9, 0), (7, 2), (3, 1), (0, 0)],
    "up": [(0, 0), (3, 1), (7, 2), (9, 0)],
    "same": [(4, 4), (4, 4), (4, 4)],
    "twice": [(5, 0), (5, 0), (2, 1), (2, 1), (0, 3)],
    "one": [(1, 1)],
}


@pytest.mark.parametrize("n", [2, 20, 40])
def test_resampling_follows_interp(spark, n):
    df = frame(spark, GROUPS)
    clean = s.clean_polyline(df, KEY, ORDER, n).orderBy("g", "point").toPandas()
    feature = s.feature_polyline(df, KEY, ORDER, n).orderBy("g", "point").toPandas()
    assert set(clean.g) == set(GROUPS) - {"one"}
    for g in set(GROUPS) - {"one"}:
        x, y = np.array(GROUPS[g], float).T
        a = (x[::-1], y[::-1]) if x[0] < x[-1] else (x, y)
        np.testing.assert_allclose(clean[clean.g == g][["x", "y"]].to_numpy().T, polyline(*a, n, True), atol=1e-9)
        fx, fy = polyline(x, y, n, False)
        b = (fx[::-1], fy[::-1]) if fx[0] < fx[-1] else (fx, fy)
        np.testing.assert_allclose(feature[feature.g == g][["x", "y"]].to_numpy().T, b, atol=1e-9)


def test_gap_is_strict_and_first_of_equals_wins(spark):
    df = frame(spark, {"a": [(0, 0), (50, 0), (100.1, 0), (101, 0)], "b": [(0, 0), (60, 0), (120, 0), (121, 0)]})
    from pyspark.sql import Window as W

    step = F.coalesce(F.abs(F.col("x") - F.lag("x").over(W.partitionBy("g").orderBy("i"))), F.lit(0.0))
    kept = {(r.g, r.i) for r in s.largest_cluster(df, KEY, ORDER, step).collect()}
    assert kept == {("a", 0), ("a", 1), ("b", 2), ("b", 3)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=1, max_size=25))
def test_interpolation_follows_pandas(spark, values):
    df = frame(spark, {"a": [(v, 0) for v in values]})
    got = [r.f for r in s.interpolated(df, KEY, ORDER, "x", "f").orderBy("i").collect()]
    want = pd.Series(values, dtype=float).interpolate(method="linear", limit_direction="both").ffill().bfill()
    np.testing.assert_allclose(np.array(got, float), want.to_numpy(), atol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 8, 30, 31, 32, 60])
def test_savgol_keeps_polynomials_and_short_series(spark, n):
    i = np.arange(n, dtype=float)
    quadratic, noisy = 3 - 2 * i + 0.5 * i * i, np.sin(i * 1.7) * 10
    df = frame(spark, {"q": [(v, 0) for v in quadratic], "n": [(v, 0) for v in noisy]})
    out = s.savgol(df, KEY, ORDER, "x", "f", 2, 7).orderBy("g", "i").toPandas()
    np.testing.assert_allclose(out[out.g == "q"].f, quadratic, atol=1e-6)
    w = min(31, n if n % 2 else n - 1)
    want = noisy
    if w >= 7:
        starts = np.clip(np.arange(n) - w // 2, 0, n - w)
        want = [np.polyval(np.polyfit(np.arange(a, a + w) - j, noisy[a : a + w], 2), 0) for j, a in enumerate(starts)]
    np.testing.assert_allclose(out[out.g == "n"].f, want, atol=1e-6)


def test_gradient_follows_numpy(spark):
    v = [3.0, 4.5, 1.0, 0.0, 8.0]
    df = frame(spark, {"a": [(x, 0) for x in v], "one": [(1, 0)]})
    out = s.gradient(df, KEY, ORDER, "x", "f").orderBy("g", "i").toPandas()
    np.testing.assert_allclose(out[out.g == "a"].f, np.gradient(v))
    assert out[out.g == "one"].f.isna().all()


def test_constant_series_scale_as_defined(spark):
    df = frame(spark, {"c": [(5, 5), (5, 5)], "v": [(1, 0), (3, 0)]})
    a = {(r.g, r.i): r.x for r in s.scaled_coords(df, KEY, ["x"]).collect()}
    b = {(r.g, r.i): r.f for r in s.scaled_intensity(df, KEY, "x", "f").collect()}
    assert a == {("c", 0): 5.0, ("c", 1): 5.0, ("v", 0): 0.0, ("v", 1): 1.0}
    assert b == {("c", 0): 0.0, ("c", 1): 0.0, ("v", 0): 0.0, ("v", 1): 1.0}


@pytest.mark.parametrize(("n", "train", "test"), [(7, 0, 5), (10, 8, 8), (19, 8, 15), (20, 16, 16), (101, 80, 83)])
def test_split_sizes(spark, n, train, test):
    out = s.head_tail_split(spark.range(n), ["id"]).orderBy("id").collect()
    assert [r.id for r in out if r.split == "train"] == list(range(train))
    assert [r.id for r in out if r.split == "test"] == list(range(test, n))


def test_clean_points_follows_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    raw, frames = [], list(range(0, 40))
    for f in frames:
        if f in (3, 4, 17):
            raw.append(("r", "top", str(f), None if f == 3 else "junk"))
            continue
        far = 400 if f == 20 else 0
        pts = [(60 - 6 * k + int(rng.integers(3)) + far, int(rng.integers(20))) for k in range(8)]
        raw.append(("r", "top", str(f), str(pts)))
    out = prepare.clean_points(spark.createDataFrame(raw, "recording string, view string, Frame_ID string, Spine_Coords string")).orderBy("frame_id", "point").toPandas()
    xs = np.full((40, 40), np.nan)
    ys = xs.copy()
    for f, (_, _, _, text) in enumerate(raw):
        if text and text.startswith("["):
            x, y = np.array(eval(text), float).T  # noqa: S307 - our own fixture
            cuts = np.flatnonzero(np.hypot(np.diff(x), np.diff(y)) > 50) + 1
            x, y = max(zip(np.split(x, cuts), np.split(y, cuts)), key=lambda p: len(p[0]))
            if x[0] < x[-1]:
                x, y = x[::-1], y[::-1]
            xs[f], ys[f] = polyline(x, y, 40, True)
    ok = ~np.isnan(xs[:, 0])
    off = ok & ((abs(xs[:, 0] - xs[ok, 0].mean()) > 2 * xs[ok, 0].std()) | (abs(ys[:, 0] - ys[ok, 0].mean()) > 2 * ys[ok, 0].std()))
    assert off[20]
    xs[off], ys[off] = np.nan, np.nan
    fill = lambda m: pd.DataFrame(m).interpolate(axis=0, limit_direction="both").ffill().bfill().to_numpy()
    got = out.pivot(index="frame_id", columns="point", values="x").to_numpy()
    np.testing.assert_allclose(got, fill(xs), atol=1e-6)
    np.testing.assert_allclose(out.pivot(index="frame_id", columns="point", values="y").to_numpy(), fill(ys), atol=1e-6)
    assert out.x_smooth.notna().all()


def test_prepared_tables_share_frames_and_a_root(spark):
    d = "/root/testdata/sf0.001"
    out = prepare.prepared(prepare.raw_curves(spark, d), prepare.intensity_table(spark, d))
    first = out["shape"].where("point = 0").agg(F.max(F.abs("x")), F.max(F.abs("top_y")), F.max(F.abs("side_y"))).first()
    assert tuple(first) == (0.0, 0.0, 0.0)
    key = ["recording", "frame_id"]
    frames = {tuple(r) for r in out["frames"].collect()}
    for name in ("shape", "intensity", "derivative"):
        assert {tuple(r) for r in out[name].select(*key).distinct().collect()} == frames


def test_preparation_reads_all_orders_and_events(spark):
    d = "/root/testdata/sf0.01"
    raw, light = prepare.raw_curves(spark, d), prepare.intensity_table(spark, d)
    keys = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey").distinct()
    assert raw.count() == raw.select("recording", "view", "Frame_ID").distinct().count() == keys.count()
    assert light.count() == light.select("recording", "frame_id", "circle", "point").distinct().count() == 20 * spark.read.parquet(f"{d}/events.parquet").count()
    ends = keys.agg(F.floor(F.max("l_orderkey") / 800)).first()[0]
    for t in (raw, light):
        assert {f"rec{i}" for i in range(ends + 1)} <= {r.recording for r in t.select("recording").distinct().collect()}


@pytest.mark.parametrize("batch", [7, 10_000])
def test_frames_as_arrays_equal_series_of_points(spark, batch):
    """Series of many lengths, missing rows at their ends and between, cut anywhere by batches."""
    rng, rows = np.random.default_rng(2), []
    for g, n in enumerate([1, 2, 5, 6, 7, 8, 15, 30, 31, 32, 45, 46, 61, 62, 130, 20, 40]):
        for i in range(n):
            there = rng.random() < (0.0 if g == 15 else 0.6) and not (g == 16 and (i < 10 or i > 25))
            rows.append((f"s{g}", i * 3, [float(v) for v in rng.integers(0, 50, 3)] if there else None))
    df = spark.createDataFrame(rows, "g string, i long, v array<double>")
    long = df.select("g", "i", F.explode(F.array(*map(F.lit, range(3)))).alias("p"), "v").withColumn("v", F.get("v", F.col("p")))
    want = s.savgol(s.interpolated(long, ["g", "p"], ["i"], "v", "v"), ["g", "p"], ["i"], "v", "f", 2, 7).orderBy("g", "i", "p").toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = s.smoothed_frames(df, ["g"], "i", ["v"], 2, 7).toPandas().sort_values(["g", "i"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(rows)
    flat = lambda c: np.concatenate([np.full(3, np.nan) if v is None else v for v in out[c]])
    np.testing.assert_allclose(flat("v"), want.v, atol=1e-9)
    np.testing.assert_allclose(flat("v_smooth"), want.f, atol=1e-9)


def test_even_frames_equal_features_of_points(spark):
    rng = np.random.default_rng(3)
    curves = [[[float(v) for v in rng.integers(0, 4, 9)] for _ in range(2)] for _ in range(60)] + [[[2.0] * 9, [1.0] * 9]]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(curves)], "g long, xs array<double>, ys array<double>")
    long = df.select("g", F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p")).select("g", "i", "p.xs", "p.ys").withColumnsRenamed({"xs": "x", "ys": "y"})
    want = s.feature_polyline(long, ["g"], ["i"], 20).orderBy("g", "point").toPandas()
    out = s.feature_frames(df, ["g"], "xs", "ys", 20).toPandas().sort_values("g")
    for c in ("x", "y"):
        np.testing.assert_allclose(np.concatenate(list(out[c])), want[c], atol=1e-9)


def test_clean_points_shuffles_texts_only(spark):
    """Two exchanges: lines by order, texts by recording and view; no point is dealt again."""
    df = prepare.clean_points(prepare.raw_curves(spark, "/root/testdata/sf0.001"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2


def test_equal_rows_of_a_frame_count_once(spark):
    curve = "[(9, 1), (6, 2), (3, 3)]"
    rows = [("r", "top", str(i), curve) for i in range(9)]
    schema = "recording string, view string, Frame_ID string, Spine_Coords string"
    once, twice = (prepare.clean_points(spark.createDataFrame(r, schema)).orderBy("frame_id", "point").collect() for r in (rows, rows + rows[:4]))
    assert len(once) == 360 and once == twice


def test_only_texts_wait_in_a_sort(spark):
    """Above the texts' exchange one sort, directly on it, and no aggregate that gathers rows."""
    plan = prepare.clean_points(prepare.raw_curves(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange ")].splitlines()
    assert not [line for line in above if "Aggregate" in line]
    assert [i for i, line in enumerate(above) if "+- Sort [" in line] == [len(above) - 2]


def test_texts_of_one_frame_meet(spark):
    """Equal curves written in two ways count once; different ones give their points in turn."""
    schema = "recording string, view string, Frame_ID string, Spine_Coords string"
    points = lambda *texts: tables.frame_spines(spark.createDataFrame([("r", "top", "1", t) for t in texts], schema), ["recording", "view", "Frame_ID"], "Spine_Coords").collect()
    once = points("[(9, 1), (6, -2.5e0)]")
    assert [tuple(p) for p in once[0].points] == [(9.0, 1.0), (6.0, -2.5)]
    assert points("[(9, 1), (6, -2.5e0)]", " [(9,1)(6,\t-2.5e0,),] ", None) == once
    (both,) = points("[(9, 1), (6, 2), (3, 3)]", "junk", "np.int64(8), np.int64(0), np.int64(7), np.int64(5)")
    assert [tuple(p) for p in both.points] == [(8.0, 0.0), (9.0, 1.0), (6.0, 2.0), (7.0, 5.0), (3.0, 3.0)]
    assert [r.points for r in points(None, "junk")] == [[]]


def test_curves_of_any_number_of_points_are_taken_evenly():
    rng = np.random.default_rng(4)
    curves = [rng.integers(0, 4, (m, 2)).astype(float) for m in [*rng.integers(2, 9, 300), 700, 701]] + [np.full((5, 2), 3.0)]
    odd = [None, np.zeros((0, 2)), np.ones((1, 2)), np.array([[0, 0], [np.inf, 1]]), np.array([[-1.7e308, 0], [1.7e308, 0]]), np.array([[0, 0], [1e307, 0]])]
    every = [*curves[:100], *odd, *curves[100:]]
    x, y = (pa.array([None if c is None else c[:, i].tolist() for c in every], pa.list_(pa.float64())) for i in (0, 1))
    there, values = s._evened(x.slice(1), y.slice(1), 40)
    assert list(there) == [not 100 <= i < 106 for i in range(1, len(every))]
    for c, v in zip(curves[1:], values[there]):
        np.testing.assert_allclose(v, np.concatenate(polyline(*c.T, 40, False)), atol=1e-9)


def test_rounding_without_decimals_equals_rounding(spark):
    values = [0.0, -0.0, 5e-7, -5e-7, 4e-7, -4e-7, 1.0000005, -1.0000005, 12.3456785, 1e9, -3e12, 1e300, float("nan"), float("inf"), None, *np.random.default_rng(5).normal(0, 90, 5_000).tolist()]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(prepare._r6("v").alias("a"), F.round("v", 6).alias("b")).collect()
    assert [repr(r.a) for r in rows] == [repr(r.b) for r in rows]
