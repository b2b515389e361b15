"""Tables, circles, graphs and streams on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.functions.ranking import positioned
from seriesforge.operators import circles, graph, metrics, raster, tables
from seriesforge.sources import files
from seriesforge.streaming import tracking


@pytest.mark.parametrize(
    ("text", "points"),
    [
        ("[(10, 5), (11, 5), (12, 6)]", [(10, 5), (11, 5), (12, 6)]),
        ("[(1.5, -2e1), (3, 4)]", [(1.5, -20), (3, 4)]),
        ("np.int64(10), np.int64(5), np.int64(11), np.int64(-5)", [(10, 5), (11, -5)]),
        (None, []),
        ("", []),
        ("[]", []),
        ("[[1,2]]", []),
        ("free text", []),
        ("__import__('os').system('true')", []),
    ],
)
def test_spine_text(spark, text, points):
    row = spark.createDataFrame([(text,)], "t string").select(tables.spine_points(F.col("t")).alias("p")).first()
    assert [(p.x, p.y) for p in row.p] == points


def test_alignment_keeps_repeats_and_verification_counts(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (9, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 3.0)], "k int, v double")
    x, y = tables.aligned([a, b], ["k"])
    assert (x.count(), y.count()) == (3, 2)
    out = {r.name: r for r in tables.verified({"a": a, "b": b}, ["k"], {"a": ["v"], "b": ["v"]}, least=1).collect()}
    assert (out["a"].n_nulls, out["b"].n_nulls, out["a"].n_common) == (1, 0, 2)
    assert not out["a"].passed and out["b"].passed


def test_required_columns_are_named(spark):
    with pytest.raises(ValueError, match="missing columns: a, c"):
        tables.require(spark.createDataFrame([(1,)], "b int"), ["c", "a", "b"])


def test_ranges_with_a_hole_an_overlap_and_full_cover(spark):
    rows = [("hole", 0, 10, 30), ("hole", 20, 30, 30), ("overlap", 0, 20, 30), ("overlap", 10, 30, 30), ("full", 0, 10, 30), ("full", 10, 30, 30), ("short", 0, 10, 30)]
    df = spark.createDataFrame(rows, "k string, range_start long, range_end long, total long")
    assert {tuple(r) for r in tables.coverage_breaks(df, ["k"], "total").collect()} == {("hole", 10, 20), ("overlap", 20, 10), ("short", 10, 30)}


def test_file_names(spark):
    names = ["a Speckle.mp4", "b LED.MP4", "c Side Fib.mp4", "d.mov", "e_segmented.mp4", "e__000000-002499_segmented.mp4", "f Fib.txt"]
    df = spark.createDataFrame([(f"/x/{n}", i) for i, n in enumerate(names)], "path string, size int")
    assert {r.path[3:] for r in files.intensity_videos(df).collect()} == {"a Speckle.mp4", "b LED.MP4"}
    assert [r.path[3:] for r in files.segmentation_videos(df).orderBy("rank").collect()] == [names[1], names[2], names[3], names[4], names[5]]
    assert [r.source for r in files.segmented_sources(df).collect()] == ["e"]


def test_csv_round_trip(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "2026-05-17 22-30-30 Side_data.csv").write_text('Frame_ID,Length_px,Avg_Thickness_px,Spine_Coords\n3,5,1.5,"[(1, 2), (3, 4)]"\n')
    row = files.read_spines(spark, str(folder)).first()
    assert (row.recording, row.view, row.Frame_ID, row.Spine_Coords) == ("2026-05-17 22-30-30", "side", "3", "[(1, 2), (3, 4)]")
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], "k int, n string, v double")
    wide = files.pivoted(df, ["k"], "n", "v", ["a", "b"])
    files.write_csv(wide, str(tmp_path / "out"))
    assert tuple(files.read_wide(spark, str(tmp_path / "out")).first()) == (1, 2.0, 3.0)
    files.write_table(wide, str(tmp_path / "t"))
    files.write_table(wide.limit(0), str(tmp_path / "t"), force=False)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_components_and_greedy_match_plain_loops(spark):
    rng = np.random.default_rng(2)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 120, (90, 2))]
    parent = list(range(120))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    conflicts = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    kept = []
    for v in range(120):
        if not any((k, v) in conflicts for k in kept):
            kept.append(v)
    out = graph.greedy_independent(spark.range(120), spark.createDataFrame(conflicts, "a long, b long"))
    assert sorted(r.id for r in out.collect()) == kept


def test_chain_of_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in graph.components(path).collect()} == {0}
    assert graph.components(path.limit(0)).count() == 0


def test_greedy_circles_of_one_place(spark):
    rows = [(0, 1, 5.0, 5.0, 10.0, 9), (0, 2, 5.0, 5.0, 10.0, 9), (0, 3, 30.0, 5.0, 10.0, 2)]
    df = spark.createDataFrame(rows, "g int, cluster long, x double, y double, r double, support int")
    kept = circles.non_overlapping(df, ["g"], [-F.col("support"), F.col("cluster")], 0.72)
    assert sorted(r.cluster for r in kept.collect()) == [1, 3]


def test_shift_without_candidates_is_zero(spark):
    df = spark.createDataFrame([("a", 100.0, 0.0), ("b", 1.0, 2.0)], "k string, dx double, dy double")
    assert {tuple(r) for r in circles.consensus_shift(df, ["k"], 8.0).collect()} == {("a", 0.0, 0.0), ("b", 1.0, 2.0)}


def test_unique_shapes_distance_is_strict(spark):
    df = spark.createDataFrame([("r", 0, [0.0, 0.0]), ("r", 1, [0.5, 0.5]), ("r", 2, [0.6, 0.6]), ("r", 3, [0.0, 0.0])], "k string, o long, v array<double>")
    assert sorted(r.o for r in metrics.unique_in_order(df, ["k"], "o", "v", 0.5).collect()) == [0, 2]


def test_tracking_stream_equals_the_batch(spark, tmp_path):
    schema = "recording string, frame_id long, dx double, dy double"
    rows = [(f"r{i % 2}", i, float(i % 5), float(i % 3)) for i in range(40)]
    source = tmp_path / "in"
    source.mkdir()
    stream = tracking.tracked_stream(spark.readStream.schema(schema).parquet(str(source)), 100.0, 50.0)

    def drain():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    for part in (rows[:17], rows[10:]):  # the second batch repeats some frames
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        drain()
    got = {(r.recording, r.frame_id): (round(r.cx, 6), round(r.cy, 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = circles.tracked(spark.createDataFrame(rows, schema).withColumn("x0", F.lit(100.0)).withColumn("y0", F.lit(50.0)), ["recording"], "frame_id")
    assert got == {(r.recording, r.frame_id): (round(r.cx, 6), round(r.cy, 6)) for r in batch.collect()}
    assert len(got) == 40


def test_windowed_stream_counts_late_rows(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", 1, 2.0), ("2024-01-01 00:06:00", 1, 4.0), ("2024-01-01 00:01:00", 1, 6.0)]
    df = spark.createDataFrame(rows, "ts string, user_id long, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tracking.running_means(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["mean"], r.n) for r in spark.table("means").collect()) == [(4.0, 1), (4.0, 2)]


def test_near_shapes_and_unique_shapes_equal_plain_loops(spark):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.normal(0, 1, (60, 4)), rng.normal(3, 0.2, (30, 4))]).round(2)
    rows = [(i % 3, i // 3, i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "k int, frame long, id long, v array<double>")
    error = lambda a, b: float(np.abs(vectors[a] - vectors[b]).mean())
    pairs = {(a, b) for a in range(90) for b in range(a + 1, 90) if error(a, b) <= 0.7}
    assert {tuple(r) for r in metrics.near_shapes(df, "id", "v", 0.7).collect()} == pairs
    assert {tuple(r) for r in metrics.near_shapes(df, "id", "v", 0.7, ["k"]).collect()} == {(a, b) for a, b in pairs if a % 3 == b % 3}
    kept = []
    for a in range(90):
        if not any((b, a) in pairs for b in kept if b % 3 == a % 3):
            kept.append(a)
    out = metrics.unique_in_order(df, ["k"], "frame", "v", 0.7)  # frames repeat from recording to recording
    assert sorted((r.k, r.frame) for r in out.collect()) == sorted((a % 3, a // 3) for a in kept)
    assert metrics.unique_in_order(df.limit(0), ["k"], "frame", "v", 0.7).count() == 0


def test_positions_are_those_of_the_whole_order(spark):
    rows = [((i * 37) % 101, str(i)) for i in range(101)] + [(50, "again")]
    out = positioned(spark.createDataFrame(rows, "a int, b string").repartition(7), ["a", "b"], "at", "n").collect()
    assert [(r.a, r.b) for r in sorted(out, key=lambda r: r.at)] == sorted(rows)
    assert sorted(r.at for r in out) == list(range(102)) and {r.n for r in out} == {102}


def test_longest_path_takes_the_longer_arm_and_single_pixels(spark):
    tree = [(0, 5, y) for y in range(4)] + [(0, 4, 4), (0, 6, 4), (0, 7, 5)]
    out = graph.longest_path(spark.createDataFrame([*tree, (1, 2, 2), (1, 2, 2)], "frame long, px long, py long"), "frame").collect()
    number = lambda f, x, y: (f << 40) + (y << 20) + x
    assert {r.id for r in out if r.frame == 0} == {number(0, *p) for p in [(7, 5), (6, 4), (5, 3), (5, 2), (5, 1), (5, 0)]}
    assert [(r.step, r.id) for r in out if r.frame == 1] == [(0, number(1, 2, 2))]


def test_evidence_of_circles_without_pixels_is_zero(spark):
    pixels = spark.createDataFrame([(f, x, y, 50.0) for f in (0, 1) for x in range(12) for y in range(12)], "frame long, px long, py long, gray double")
    places = spark.createDataFrame([(0, 6.0, 6.0, 3.0), (1, 90.0, 90.0, 3.0)], "circle long, x double, y double, r double")
    out = {(r.frame, r.circle): r.score for r in raster.circle_evidence(pixels, places, 12, 12).collect()}
    assert out == {(f, c): 0.0 for f in (0, 1) for c in (0, 1)}


def test_patches_outside_the_frame_are_zero(spark):
    pixels = spark.createDataFrame([(f, x, y, 10.0 * (f + 1)) for f in (0, 1) for x in range(9) for y in range(9)], "frame long, px long, py long, gray double")
    centres = spark.createDataFrame([(0, 0, 4.0, 4.0, 2.0), (1, 0, 4.0, 4.0, 2.0), (1, 1, 60.0, 4.0, 2.0)], "frame long, circle long, x double, y double, r double")
    out = {(r.frame, r.circle, r.point): r.value for r in raster.patch_means(pixels, raster.sample_points(centres, ["frame", "circle"]), 9, 9).collect()}
    assert out == {(f, c, p): 0.0 if c else 10.0 * (f + 1) for f, c in ((0, 0), (1, 0), (1, 1)) for p in range(1, 10)}


def test_files_of_one_path_and_size_are_ranked_by_the_other_columns(spark):
    rows = [(f"/d/{i % 3}.mp4", 7, 100 - i) for i in range(90)]
    df = spark.createDataFrame(rows, "path string, size long, page_id long")
    ranks = [(r.path, r.page_id) for r in files.segmentation_videos(df.repartition(7)).orderBy("rank").collect()]
    assert ranks == sorted((p, i) for p, _, i in rows)


def test_longest_paths_are_found_in_batches_of_frames(spark):
    """Frames share a task's batches; no group of its own is made for each."""
    rows = [(f, x, f % 5) for f in range(50) for x in range(f + 1)]
    out = graph.longest_path(spark.createDataFrame(rows, "frame long, px long, py long"), "frame")
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.orderBy("frame", "step").collect():
        got.setdefault(r.frame, []).append(r.id)
    for f in range(50):
        line = [(f << 40) + (f % 5 << 20) + x for x in range(f + 1)]
        assert got[f] in (line, line[::-1])
