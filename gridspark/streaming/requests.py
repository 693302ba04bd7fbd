"""Tile request streams: merged windows, newest batches, stale drops.

Frames stand in for time: frame f is f seconds past the epoch, so watermarks count frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.tiles import KEY

MAX_AGE = 30


def with_frame_time(requests: DataFrame) -> DataFrame:
    return requests if "frame_ts" in requests.columns else requests.withColumn("frame_ts", F.timestamp_seconds("frame"))


def merged_windows(requests: DataFrame, frames: int = MAX_AGE, lateness: int | None = None) -> DataFrame:
    """One row per tile and window of frames: duplicates merge and are not sent again.

    Works on a batch; a stream gives the ``lateness`` in frames, and closed windows are emitted once.
    """
    timed = with_frame_time(requests)
    if lateness is not None:
        timed = timed.withWatermark("frame_ts", f"{lateness} seconds")
    out = timed.groupBy(F.window("frame_ts", f"{frames} seconds"), *KEY).agg(
        F.max("priority").alias("priority"), F.max("kind").alias("kind"), F.max("frame").alias("frame"),
        F.count(F.lit(1)).alias("merged"))
    return out.select((F.unix_timestamp("window.start") / frames).cast("int").alias("window_no"), *KEY, "priority", "kind", "frame", "merged")


def in_flight(requests: DataFrame, lateness: int = MAX_AGE) -> DataFrame:
    """First request of each tile; repeats within the lateness are dropped and the state expires."""
    return with_frame_time(requests).withWatermark("frame_ts", f"{lateness} seconds").dropDuplicatesWithinWatermark(KEY)


def frame_batches(requests: DataFrame, lateness: int = 1) -> DataFrame:
    """Counts per frame, one frame late: a frame is emitted when the next one has been seen."""
    timed = with_frame_time(requests).withWatermark("frame_ts", f"{lateness} seconds")
    out = timed.groupBy(F.window("frame_ts", "1 second"), "layer").agg(
        F.count(F.lit(1)).alias("n"), F.max("priority").alias("priority"))
    return out.select("layer", F.unix_timestamp("window.start").cast("int").alias("frame"), "n", "priority")


class LastSeen(StatefulProcessor):
    """Pending request of one tile; it is dropped when it was last asked for more than ``max_age`` frames ago."""

    def __init__(self, max_age: int):
        self.max_age = max_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "priority int, kind int, frame int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = None
        for part in rows:
            if len(part):
                most = tuple(int(part[c].max()) for c in ("priority", "kind", "frame"))
                new = most if new is None else tuple(max(a, b) for a, b in zip(new, most))
        if new is None:
            return
        if self.pending.exists():
            new = tuple(max(a, b) for a, b in zip(self.pending.get(), new))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.pending.update(new)
        self.handle.registerTimer((new[2] + self.max_age + 1) * 1000)
        yield pd.DataFrame([(*key, *new, "pending")], columns=[*KEY, "priority", "kind", "frame", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = (*key, *self.pending.get(), "dropped")
        self.pending.clear()
        yield pd.DataFrame([out], columns=[*KEY, "priority", "kind", "frame", "state"])

    def close(self) -> None:
        pass


def stale_stream(requests: DataFrame, max_age: int = MAX_AGE) -> DataFrame:
    """Updates and drops of pending requests; the watermark drives the drops."""
    timed = with_frame_time(requests).withWatermark("frame_ts", "0 seconds")
    return timed.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=LastSeen(max_age),
        outputStructType="layer int, mip int, y int, x int, priority int, kind int, frame int, state string",
        outputMode="Append", timeMode="EventTime")
