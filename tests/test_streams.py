"""Streams and resumable runs: micro-batches, late rows, restarts, timers and state brought along."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesforge.operators import circles, series
from seriesforge.streaming import runs, tracking

FRAMES = "recording string, frame_id long, dx double, dy double"


def drain(stream, folder):
    return runs.drained(stream, str(folder)).collect()


def test_tracking_goes_on_from_state_that_is_brought_along(spark, tmp_path):
    rows = [(f"r{i % 2}", i, float(i % 5), float(i % 3)) for i in range(40)] + [("r0", None, 1.0, 1.0), ("r1", 7, 5.0, 5.0)]
    df = spark.createDataFrame(rows, FRAMES)
    whole = df.dropna().dropDuplicates(["recording", "frame_id"]).where("not (recording = 'r1' and frame_id = 7 and dx = 5.0)")
    want = circles.tracked(whole.withColumn("x0", F.lit(100.0)).withColumn("y0", F.lit(50.0)), ["recording"], "frame_id").collect()
    before = [r for r in want if r.frame_id < 20]
    ends = {r.recording: r for r in sorted(before, key=lambda r: r.frame_id)}
    start = spark.createDataFrame([(r.recording, r.frame_id, r.cx, r.cy) for r in ends.values()], "recording string, frame_id long, cx double, cy double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tracking.tracked_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 0.0, 0.0, start=start)
    got = {(r.recording, r.frame_id): (round(r.cx, 6), round(r.cy, 6)) for r in drain(stream, tmp_path / "run")}
    assert got == {(r.recording, r.frame_id): (round(r.cx, 6), round(r.cy, 6)) for r in want if r.frame_id >= 20}


def test_gap_sessions_equal_the_batch_with_late_rows(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"s{i % 4}", i, rnd.choice([0.0, 10.0, 100.0]) if i % 7 == 0 else float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "series string, place long, value double").withColumn("ts", F.timestamp_seconds(F.col("place") + 1))
    step = F.abs(F.col("value") - F.lag("value").over(W.partitionBy("series").orderBy("place")))
    want = {(r.series, r.place, r.cluster) for r in series.largest_cluster(df, ["series"], ["place"], F.coalesce(step, F.lit(0.0))).collect()}
    source, end = tmp_path / "in", [("end", 10_000_000, 0.0)]
    source.mkdir()
    order = sorted(rows, key=lambda r: r[1] + rnd.randrange(8))  # late by seven seconds at most
    parts = [order[:60], order[60:61], order[61:150], [*order[150:], ("s0", None, None)], end]
    stream = tracking.gap_sessions(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source)), 50.0, "10 seconds", 300_000)
    for part in parts:
        spark.createDataFrame(part, "series string, place long, value double").withColumn("ts", F.timestamp_seconds(F.col("place") + 1)).coalesce(1).write.mode("append").parquet(str(source))
        out = drain(stream, tmp_path / "run")
    assert {(r.series, r.place, r.cluster) for r in out} == want
    assert len(out) == len(want)


@pytest.mark.parametrize("stop", ["after a batch", "between rows and manifest"])
def test_a_run_that_ends_half_way_gives_the_table_once(spark, tmp_path, stop):
    ranges = spark.createDataFrame([(f"r{i % 5}", i * 10) for i in range(30)] + [("r0", None)], "recording string, range_start long")
    seen, path = [], str(tmp_path)

    def process(some):
        seen.append(some.count())
        return some.select("recording", "range_start", (F.col("range_start") * 2).alias("y"))

    key = ["recording", "range_start"]
    assert runs.finished(spark, path) is None
    if stop == "after a batch":
        assert runs.run_ranges(ranges, key, process, path, most=2) == 2
    else:
        class Stopped(Exception):
            pass

        def fails(some):
            if len(seen) == 2:  # the rows of the third batch are written, then the run ends
                process(some).write.parquet(f"{path}/rows/batch=lost")
                raise Stopped
            return process(some)

        with pytest.raises(Stopped):
            runs.run_ranges(ranges, key, fails, path)
        seen.pop()
    assert 0 < runs.finished(spark, path).count() < 30
    runs.run_ranges(ranges, key, process, path)
    assert runs.run_ranges(ranges, key, process, path) == 0
    out = runs.finished(spark, path).collect()
    assert sorted((r.recording, r.range_start, r.y) for r in out) == sorted((f"r{i % 5}", i * 10, i * 20) for i in range(30))
    assert sum(seen) == 30
    more = ranges.unionByName(spark.createDataFrame([("new", 5)], "recording string, range_start long"))
    assert runs.run_ranges(more, key, process, path) == 1
    assert runs.finished(spark, path).count() == 31


def test_a_repeated_micro_batch_overwrites_its_rows(spark, tmp_path):
    write = runs.batch_writer(str(tmp_path))
    for number in (0, 1, 1):
        write(spark.range(number, number + 3), number)
    assert spark.read.parquet(str(tmp_path)).count() == 6
