"""Telemetry streams: slow sessions, slow runs, throttled refreshes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.throttle import chain_from
from .ordering import InOrder, seen_by_watermark


def slow_sessions(waits: DataFrame, by: list[str], limit_ms: float, gap: str, time: str = "ts",
                  lateness: str | None = None) -> DataFrame:
    """Sessions of slow waits no further apart than ``gap``: start, end of the last wait, count, worst."""
    if lateness:
        waits = waits.withWatermark(time, lateness)
    slow = waits.where(seen_by_watermark(time, F.col("wait_ms") >= limit_ms))
    return slow.groupBy(F.session_window(time, gap).alias("session"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.max("wait_ms").alias("worst"), F.max(time).alias("last"))


class SlowRuns(InOrder):
    """Runs of consecutive slow waits of one key; a fast wait closes the open run, and with it the state.

    An absent wait ends a run too, but as it may have been slow, the run is held back until a fast one has come.
    """

    columns = "t_us bigint, event_id bigint, slow boolean"
    remembered = "length bigint, start bigint, last bigint, held array<bigint>"  # held: length, start and end of each run
    keys = ("key",)

    def __init__(self, least: int):
        self.least = least

    def fold(self, rows: pd.DataFrame, passed: int) -> pd.DataFrame:
        length, start, last, held = self.state.get() if self.state.exists() else (0, 0, 0, [])
        times, slow = rows["t_us"].to_numpy(np.int64), rows["slow"].eq(True).to_numpy(bool)
        other = np.flatnonzero(~slow)
        # Waits between fast or absent ones; the first stretch goes on with the open run, the last one stays open.
        low, high = np.concatenate([[0], other + 1]), np.concatenate([other, [len(times)]])
        sizes = high - low
        begins = np.where(sizes > 0, times[np.minimum(low, max(len(times) - 1, 0))], 0) if len(times) else np.zeros(1, np.int64)
        ends = np.where(sizes > 0, times[np.maximum(high - 1, 0)], 0) if len(times) else np.zeros(1, np.int64)
        if length:
            begins[0], ends[0] = start, ends[0] if sizes[0] else last
            sizes[0] += length
        fast = np.flatnonzero(rows["slow"].notna().to_numpy(bool)[other])
        closed = np.arange(len(other)) <= (fast[-1] if len(fast) else -1)  # a fast wait has come since
        runs, enough = np.column_stack([sizes, begins, ends])[:-1], sizes[:-1] >= self.least
        done, held = runs[closed & enough], np.array(held, np.int64).reshape(-1, 3)
        if len(fast):
            done, held = np.concatenate([held, done]), held[:0]
        held = np.concatenate([held, runs[~closed & enough]])
        if sizes[-1] or len(held):
            self.state.update((int(sizes[-1]), int(begins[-1]), int(ends[-1]), held.ravel().tolist()))
        elif self.state.exists():
            self.state.clear()
        return pd.DataFrame(done, columns=["length", "start", "end"])


def slow_run_stream(waits: DataFrame, least: int = 3, lateness: str = "1 hour") -> DataFrame:
    """Closed slow runs of a stream of (key, time TIMESTAMP, t_us, event_id, slow), in order of time however rows arrive.

    ``slow`` is NULL for an absent wait.
    """
    rows = waits.withWatermark("time", lateness).where(seen_by_watermark("time", F.col("key").isNotNull()))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=SlowRuns(least), outputStructType="key string, length bigint, start bigint, end bigint",
        outputMode="Append", timeMode="EventTime")


class Throttle(InOrder):
    """Lets an attempt through when the last one that was made is far enough in the past."""

    columns, remembered = "t_us bigint, event_id bigint", "made bigint"
    keys = ("object_id",)

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def fold(self, rows: pd.DataFrame, passed: int) -> pd.DataFrame:
        first = rows.drop_duplicates("t_us")  # of equal times the first by id
        times = first["t_us"].to_numpy(np.int64)
        start = self.state.get()[0] + self.gap_us if self.state.exists() else np.iinfo(np.int64).min
        made = chain_from(times, start, self.gap_us)
        if len(made):
            self.state.update((int(made[-1]),))
        return first[first["t_us"].isin(made)][["t_us", "event_id"]].reset_index(drop=True)


def throttle_stream(attempts: DataFrame, gap_us: int, lateness: str = "1 hour") -> DataFrame:
    """Attempts made of a stream of (object_id, time TIMESTAMP, t_us, event_id), in order of time however rows arrive."""
    rows = attempts.withWatermark("time", lateness).where(seen_by_watermark("time", F.col("object_id").isNotNull()))
    return rows.groupBy("object_id").transformWithStateInPandas(
        statefulProcessor=Throttle(gap_us), outputStructType="object_id bigint, t_us bigint, event_id bigint",
        outputMode="Append", timeMode="EventTime")
