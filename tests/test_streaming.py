"""Streams over one file per day agree with the batch operators over the same rows."""

import time
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridspark import adapters as A
from gridspark.functions import timefn
from gridspark.operators import requests as R, throttle
from gridspark.plans import benchmarks, composites
from gridspark.sinks.generations import current, read_generation
from gridspark.streaming import observations as O, refresh, requests as SR, runs, sources, telemetry as ST

FOLDER = "/root/testdata/sf0.001"
HOUR = timefn.HOUR_US


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    """The events as one file per ten days, in time order."""
    root = tmp_path_factory.mktemp("events")
    ev = A.events(spark, FOLDER).withColumn("day", F.floor(F.col("t_us") / (10 * timefn.DAY_US)))
    out = str(root / "all")
    for i, row in enumerate(ev.select("day").distinct().orderBy("day").collect()):
        ev.where(F.col("day") == row.day).drop("day").withColumn("time", F.col("ts").cast("timestamp")) \
            .coalesce(1).write.mode("append").parquet(out)
    return out, spark.read.parquet(out).schema


def stream_of(spark, days):
    return sources.file_stream(spark, days[0], days[1])


def finish(spark, df, tmp_path, mode="append"):
    """Run a stream through what is there and return what it wrote."""
    name = "s" + uuid.uuid4().hex
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name)


def rows(df, *cols):
    return sorted(tuple("" if v is None else v for v in r) for r in df.select(*cols).collect())


def close(a, b):
    assert len(a) == len(b)
    for p, q in zip(a, b):
        assert all(x == y or x == pytest.approx(y, abs=1e-9) for x, y in zip(p, q))


def test_refresh_publishes_a_generation_per_batch(spark, days, tmp_path):
    root = str(tmp_path / "store")
    q = refresh.refresh(stream_of(spark, days), lambda b: b.groupBy("event_type").count(), root, str(tmp_path / "ck"), every=None)
    q.awaitTermination(300)
    last = current(spark, root)
    files = len(list(Path(days[0]).glob("*.parquet")))
    assert files >= 3 and int(last) == files - 1 and read_generation(spark, root).count() == 5


def test_failed_refresh_keeps_the_last_good(spark, days, tmp_path):
    root = str(tmp_path / "store")

    def build(batch):
        if batch.where("t_us > 1705000000000000").count():
            raise ValueError("source broken")
        return batch

    q = refresh.refresh(stream_of(spark, days), build, root, str(tmp_path / "ck"), every=None)
    with pytest.raises(Exception):
        q.awaitTermination(300)
    assert current(spark, root) == "000000000000"


def product_hours(df):
    return df.select(F.when(F.col("event_id") % 2 == 0, "VIS").otherwise("LW").alias("product"), (F.col("user_id") % 3).alias("site"),
                     timefn.floor_to("t_us", HOUR).alias("hour_us"))


def test_newest_pairs(spark, days, tmp_path):
    stream = finish(spark, O.newest_pairs(product_hours(stream_of(spark, days)), ["site"]), tmp_path, "complete")
    batch = O.newest_pairs(product_hours(A.events(spark, FOLDER)), ["site"])
    assert rows(stream, *batch.columns) == rows(batch, *batch.columns)


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The events dealt over files at random: rows arrive in no order, and far too late for a short watermark."""
    out = str(tmp_path_factory.mktemp("shuffled") / "all")
    ev = A.events(spark, FOLDER).withColumn("time", F.timestamp_micros("t_us")).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    for part in range(3):
        ev.where(F.col("part") == part).drop("part").orderBy(F.xxhash64("event_id", F.lit(1))).coalesce(1).write.mode("append").parquet(out)
    return out, spark.read.parquet(out).schema


LONG = "4000 days"


def test_strict_pairs(spark, shuffled):
    def pairs(df):
        best = lambda rest: O.hourly_best(df.select((F.col("user_id") % 2).alias("site"), "time", "event_id", "value"), ["site"],
                                          F.when(F.expr(f"event_id % 2 = {rest} and event_id % 5 < 2"), F.col("value")), LONG).where("value is not null")
        return O.strict_pairs(best(0), best(1), ["site"])
    out, _ = runs.run_closed(stream_of(spark, shuffled), "time", pairs)
    got = rows(out.select("site", F.date_trunc("hour", "at").alias("hour"), "vis", "ir"), "site", "hour", "vis", "ir")
    b = spark.read.parquet(shuffled[0]).where("event_id % 5 < 2").select((F.col("user_id") % 2).alias("site"), F.date_trunc("hour", "time").alias("hour"), "event_id", "value")
    want = b.groupBy("site", "hour").agg(F.max(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("vis"), F.max(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("ir"))
    assert got == rows(want, "site", "hour", "vis", "ir")
    assert any(r[2] == "" for r in got) and any(r[3] == "" for r in got) and any("" not in r for r in got)


def test_composites_of_shuffled_observations(spark, shuffled):
    obs = A.observations(spark, FOLDER)
    clock = composites.update_clock(composites.update_runs(obs))
    out, checkpoint = runs.run_closed(stream_of(spark, shuffled), "time", lambda df: O.composite_stream(
        O.field_rows(A.as_observations(df, "time"), clock), A.OBS_W, LONG))
    fields = ("vis_clear", "ir_day", "ir_night")
    cols = ["run_us", "y", "x", *fields]
    close(rows(out.withColumns({"y": F.col("tile").cast("int"), "x": F.col("place")}), *cols), rows(composites.composites(composites.hourly_fields(obs)), *cols))
    assert out.where(" or ".join(f"isnan({c})" for c in fields)).count() == 0
    state = runs.stored_state(spark, checkpoint, "state")
    assert state.count() == obs.select("y").distinct().count() and runs.stored_state(spark, checkpoint, "due").count() == 0


def test_retained_records_expire(spark, tmp_path):
    """The state of each product goes when its own time to live has passed without an update."""
    schema = "product string, place long, hour_us long"
    path = str(tmp_path / "products")
    first = [("clouds", p, 5) for p in range(4)] + [("clouds", 0, 3), ("ice", 1, 7), ("other", 1, 1), (None, 1, 1)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(path)
    stream = O.retained_stream(sources.file_stream(spark, path, schema), {"clouds": 3 / 3600, "ice": 24.0})
    checkpoint = str(tmp_path / "ck")

    def once():
        stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination()
        return {p: sorted((r.place, r.value.value.hour_us) for r in runs.stored_state(spark, checkpoint, p).select("key.place", "value").collect())
                for p in ("clouds", "ice")}

    assert once() == {"clouds": [(p, 5) for p in range(4)], "ice": [(1, 7)]}
    time.sleep(4)
    spark.createDataFrame([("clouds", 9, 8), ("ice", 1, 2)], schema).coalesce(1).write.mode("append").parquet(path)
    assert once() == {"clouds": [(9, 8)], "ice": [(1, 7)]}


def test_first_of_hour(spark, days, tmp_path):
    s = stream_of(spark, days).select((F.col("user_id") % 3).alias("site"), F.date_trunc("hour", "time").alias("hour"))
    stream = finish(spark, O.first_of_hour(s, ["site"]), tmp_path)
    batch = spark.read.parquet(days[0]).select((F.col("user_id") % 3).alias("site"), F.date_trunc("hour", "time").alias("hour")).distinct()
    assert rows(stream, "site", "hour") == rows(batch, "site", "hour")


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_rollups(spark, days, tmp_path, slide):
    size = "6 hours" if slide is None else "1 hour"
    stream = finish(spark, O.rollup_windows(stream_of(spark, days), ["event_type"], "value", size, slide, "time", "1 hour"), tmp_path)
    batch = O.rollup_windows(spark.read.parquet(days[0]), ["event_type"], "value", size, slide, "time")
    got, want = set(rows(stream, "window.start", "event_type", "n", "max")), set(rows(batch, "window.start", "event_type", "n", "max"))
    # Windows the watermark has not passed yet stay open at the end of the input.
    last = max(r[0] for r in want)
    assert got <= want and all((last - r[0]).total_seconds() <= 8 * 3600 for r in want - got)


def test_slow_sessions(spark, shuffled):
    def waits(df):
        return df.select("event_type", "time", F.col("value").alias("wait_ms"))
    out, _ = runs.run_closed(stream_of(spark, shuffled), "time", lambda df: ST.slow_sessions(waits(df), ["event_type"], 60, "1 hour", "time", LONG))
    batch = ST.slow_sessions(waits(spark.read.parquet(shuffled[0])), ["event_type"], 60, "1 hour", "time")
    got = rows(out, "event_type", "last", "n")
    assert got == rows(batch, "event_type", "last", "n") and len(got) > 10


@pytest.mark.parametrize("lateness", [LONG, "0 seconds"])
def test_slow_runs_in_event_time(spark, shuffled, days, lateness):
    """Shuffled rows under a long watermark, and ordered ones under none, give the runs of the batch."""
    def waits(df):
        return df.select(F.col("event_type").alias("key"), "time", "t_us", "event_id", (F.col("value") >= 30).alias("slow"))
    source = shuffled if lateness == LONG else days
    out, checkpoint = runs.run_closed(stream_of(spark, source), "time", lambda df: ST.slow_run_stream(waits(df), 3, lateness))
    every = benchmarks.slow_runs(waits(A.events(spark, FOLDER).withColumn("time", F.lit(None))), ["key"], ["t_us", "event_id"], F.col("slow"), float(timefn.DAY_US))
    last = {r.key: r.t for r in A.events(spark, FOLDER).where("value < 30").groupBy(F.col("event_type").alias("key")).agg(F.max("t_us").alias("t")).collect()}
    got, want = rows(out, "key", "length", "start", "end"), rows(every, "key", "length", "start", "end")
    assert got == [r for r in want if r[2] < last[r[0]]] and len(got) > 5
    held = runs.stored_state(spark, checkpoint, "state").count()  # only keys whose run is open
    assert held == len({r.event_type for r in A.events(spark, FOLDER).collect() if r.t_us > last[r.event_type]})


def test_throttle_equals_the_batch(spark, shuffled):
    def attempts(df):
        return df.select((F.col("user_id") % 3).alias("object_id"), "time", "t_us", "event_id")
    out, _ = runs.run_closed(stream_of(spark, shuffled), "time", lambda df: ST.throttle_stream(attempts(df), 6 * HOUR, LONG))
    cols = ["object_id", "t_us", "event_id"]
    batch = throttle.throttled(attempts(A.events(spark, FOLDER).withColumn("time", F.lit(None))).select(*cols), ["object_id"], "t_us", ["event_id"], 6 * HOUR)
    got = rows(out, *cols)
    assert got == rows(batch, *cols) and len(got) > 100


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("frames") / "all")
    req = A.requests(spark, FOLDER).select("event_id", "layer", "mip", "y", "x", "priority", "kind", "frame")
    for lo in (0, 40, 80):
        req.where((F.col("frame") >= lo) & (F.col("frame") < lo + 40)).coalesce(1).write.mode("append").parquet(out)
    return out, req.schema


def test_merged_windows_and_batches(spark, frames, tmp_path):
    cols = ["window_no", "layer", "mip", "y", "x", "priority", "kind", "frame", "merged"]
    stream = finish(spark, SR.merged_windows(stream_of(spark, frames), lateness=1), tmp_path)
    want = rows(SR.merged_windows(spark.read.parquet(frames[0])), *cols)
    got = rows(stream, *cols)
    assert set(got) <= set(want) and {r[0] for r in want} - {r[0] for r in got} <= {max(r[0] for r in want)}
    batches = finish(spark, SR.frame_batches(stream_of(spark, frames)), tmp_path).collect()
    top = sorted({r.frame for r in batches})[-3:]
    newest = R.newest_batches(spark.read.parquet(frames[0])).select("frame").distinct().collect()
    assert len(top) == 3 and max(top) >= max(r.frame for r in newest) - 2


def test_in_flight_sends_each_tile_once(spark, frames, tmp_path):
    stream = finish(spark, SR.in_flight(stream_of(spark, frames), lateness=10_000), tmp_path)
    assert stream.count() == spark.read.parquet(frames[0]).select("layer", "mip", "y", "x").distinct().count()


def test_stale_requests_are_dropped(spark, tmp_path):
    schema = "layer int, mip int, y int, x int, priority int, kind int, frame int"
    path = str(tmp_path / "req")
    for batch in ([(1, 0, 0, 0, 5, 1, 1), (1, 0, 0, 1, 5, 1, 1)], [(1, 0, 0, 1, 9, 1, 20)], [(1, 0, 0, 2, 1, 1, 40)], [(1, 0, 0, 2, 1, 1, 41)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    out = finish(spark, SR.stale_stream(sources.file_stream(spark, path, schema)), tmp_path).where("state = 'dropped'").collect()
    assert [(r.x, r.frame) for r in out] == [(0, 1)]
