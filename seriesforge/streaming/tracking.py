"""Streaming twins of the series operators: typed state kept by recording, and timers of event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Typed state needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _typed(df: DataFrame) -> None:
    """Sets the state store of the session to the one that typed state needs."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _columns(rows: Iterator[pd.DataFrame], names: list[str]) -> list[np.ndarray]:
    """The columns of a key's rows, without rows that lack the first: keys are many and their rows few, so frames are not joined or sorted as such."""
    parts = [[part[n].to_numpy() for n in names] for part in rows]
    columns = [p[0] if len(p) == 1 else np.concatenate(p) for p in zip(*parts)]
    if columns[0].dtype.kind in "fO":  # whole numbers that hold nulls
        there = ~pd.isna(columns[0])
        columns = [c[there] for c in columns]
        columns[0] = columns[0].astype("int64")
    return columns


class _Tracker(StatefulProcessor):
    """The last frame and centre of a recording."""

    def __init__(self, x0: float, y0: float, alpha: float) -> None:
        self.start, self.alpha = (None, x0, y0), alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "frame_id long, cx double, cy double")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[-1]
        self.at.update((int(row["frame_id"]), float(row["cx"]), float(row["cy"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.at.get()
        last, cx, cy = self.start if state is None else state
        frame, dx, dy = _columns(rows, ["frame_id", "dx", "dy"])
        frame, first = np.unique(frame, return_index=True)  # sorted; of repeats the first
        if last is not None:
            frame, first = frame[frame > last], first[frame > last]
        if len(frame):
            share = np.full(len(frame), self.alpha)
            share[0] = share[0] if last is not None else 1.0
            # Shifts add up from the centre that the last batch left.
            xs = np.cumsum(np.concatenate([[cx], share * dx[first]]))[1:]
            ys = np.cumsum(np.concatenate([[cy], share * dy[first]]))[1:]
            self.at.update((int(frame[-1]), float(xs[-1]), float(ys[-1])))
            yield pd.DataFrame({"recording": key[0], "frame_id": frame.astype("int64"), "cx": xs, "cy": ys})

    def close(self) -> None:
        pass


def tracked_stream(frames: DataFrame, x0: float, y0: float, alpha: float = 0.70, start: DataFrame | None = None) -> DataFrame:
    """Centres that follow each frame's shift (recording, frame_id, dx, dy), across micro-batches.

    The first frame moves the centre by its whole shift, later ones by ``alpha``
    of theirs. State is one row a recording; ``start`` (recording, frame_id, cx,
    cy) is where recordings stood that were tracked before. Frames of a recording
    must arrive in order between batches; inside a batch they are sorted, and a
    frame at or before the last one seen counts as a repeat and is dropped, so a
    restarted source adds nothing twice. Rows without a frame are left out.
    """
    _typed(frames)
    state = start.select("recording", F.col("frame_id").cast("long"), F.col("cx").cast("double"), F.col("cy").cast("double")).groupBy("recording") if start is not None else None
    rows = frames.select("recording", F.col("frame_id").cast("long"), F.col("dx").cast("double"), F.col("dy").cast("double"))
    kind = rows.schema["recording"].dataType.simpleString()
    return rows.groupBy("recording").transformWithStateInPandas(_Tracker(x0, y0, alpha), f"recording {kind}, frame_id long, cx double, cy double", "append", "None", state)


class _Sessions(StatefulProcessor):
    """The points of a series that are not final yet, its open run, and its longest closed run."""

    def __init__(self, gap: float, idle: int) -> None:
        self.gap, self.idle = gap, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        point = "ms long, place long, value double"
        self.handle = handle
        self.pending, self.run, self.best = (handle.getListState(name, point) for name in ("pending", "run", "best"))
        self.seen = handle.getValueState("seen", "clusters long, best long, last long")

    def _settle(self, key, timerValues, fresh: list[tuple[int, int, float]] | tuple = ()) -> Iterator[pd.DataFrame]:
        """Points up to the watermark join the open run or close it; a series that has been still for long is given out."""
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted([*self.pending.get(), *fresh])
        ready = [p for p in waiting if p[0] <= now]
        if fresh and not ready:
            self.pending.appendList(fresh)
        clusters, best_at, last = self.seen.get() or (0, -1, 0)
        if ready:
            run, best = list(self.run.get()), list(self.best.get())
            for p in ready:
                if run and abs(p[2] - run[-1][2]) > self.gap:
                    if len(run) > len(best):
                        best, best_at = run, clusters
                    run, clusters = [], clusters + 1
                run.append(p)
            last = max(last, ready[-1][0])
            waiting = waiting[len(ready) :]
            self.run.put(run)
            if best:
                self.best.put(best)
            if waiting:
                self.pending.put(waiting)
            else:
                self.pending.clear()
            self.seen.update((clusters, best_at, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            self.handle.registerTimer(waiting[0][0])
        elif now < last + self.idle:
            self.handle.registerTimer(last + self.idle)
        else:
            run, best = list(self.run.get()), list(self.best.get())
            if len(run) > len(best):
                best, best_at = run, clusters
            for state in (self.pending, self.run, self.best, self.seen):
                state.clear()
            if best:
                yield pd.DataFrame({"series": key[0], "place": [p[1] for p in best], "value": [p[2] for p in best], "cluster": best_at})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ms, place, value = _columns(rows, ["ms", "place", "value"])
        there = ~pd.isna(value)
        yield from self._settle(key, timerValues, list(zip(ms[there].tolist(), place[there].astype("int64").tolist(), value[there].astype(float).tolist())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues)

    def close(self) -> None:
        pass


def gap_sessions(points: DataFrame, gap: float = 50.0, late: str = "10 seconds", idle: int = 60_000) -> DataFrame:
    """Rows of each series' longest run without a gap (series, place, value, cluster), once the watermark has closed the series.

    Points (series, ts, place, value) are ordered by time, then place, and may
    come late by up to ``late``; a point is final when the watermark passes it.
    Final points make runs, parted where the value jumps by more than ``gap``;
    state holds the points that are not final, the open run and the longest
    closed one. A series without points for ``idle`` milliseconds of event time
    is given out and forgotten. Points without time or value are left out.
    """
    _typed(points)
    kind = points.schema["series"].dataType.simpleString()
    rows = points.withWatermark("ts", late).select("series", "ts", F.unix_millis("ts").alias("ms"), F.col("place").cast("long"), F.col("value").cast("double"))
    return rows.groupBy("series").transformWithStateInPandas(_Sessions(gap, idle), f"series {kind}, place long, value double, cluster long", "append", "EventTime")


def running_means(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Mean, range and number of values for each user and window of event time; late rows count until the watermark."""
    late = events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "user_id")
    out = late.agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "user_id", "mean", "low", "high", "n")
