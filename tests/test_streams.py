"""Streams in sessions that did not set up a state store."""

import threading

import pytest
from pyspark.sql import functions as F

from gridspark.streaming import observations, runs, sources, telemetry


@pytest.fixture
def plain_store(spark):
    """Spark's default state store, which has no column families."""
    before = spark.conf.get(runs.PROVIDER)
    spark.conf.set(runs.PROVIDER, runs.PLAIN)
    yield
    assert spark.conf.get(runs.PROVIDER) == runs.PLAIN  # the session keeps its own setting
    spark.conf.set(runs.PROVIDER, before)


def test_keyed_state_under_the_default_store(spark, plain_store, tmp_path):
    rows = spark.range(8).select(
        F.lit("a").alias("key"), F.timestamp_seconds(F.col("id") + 86_400).alias("time"), ((F.col("id") + 86_400) * 1_000_000).alias("t_us"),
        F.col("id").alias("event_id"), (F.col("id") % 4 != 3).alias("slow"))
    rows.write.parquet(str(tmp_path / "waits"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "waits"))
    out, checkpoint = runs.run_closed(source, "time", telemetry.slow_run_stream)
    assert sorted(map(tuple, out.collect())) == [("a", 3, 86_400_000_000, 86_402_000_000), ("a", 3, 86_404_000_000, 86_406_000_000)]
    assert runs.stored_state(spark, checkpoint, "state").count() == 0


def test_state_has_a_part_a_core(spark, tmp_path):
    before = spark.conf.get(runs.PARTITIONS)
    spark.conf.set(runs.PARTITIONS, "40")
    try:
        rows = spark.range(6).select((F.col("id") % 3).alias("object_id"), F.timestamp_seconds(F.col("id") + 86_400).alias("time"),
                                     ((F.col("id") + 86_400) * 1_000_000).alias("t_us"), F.col("id").alias("event_id"))
        rows.write.parquet(str(tmp_path / "attempts"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "attempts"))
        out, checkpoint = runs.run_closed(source, "time", lambda r: telemetry.throttle_stream(r, 10_000_000))
        assert sorted(r["event_id"] for r in out.collect()) == [0, 1, 2]
        parts = spark.read.format("state-metadata").load(checkpoint).select("numPartitions").distinct().collect()
        assert [r[0] for r in parts] == [min(40, spark.sparkContext.defaultParallelism)]
        assert spark.conf.get(runs.PARTITIONS) == "40"  # the session keeps its own setting
    finally:
        spark.conf.set(runs.PARTITIONS, before)


def test_streams_started_side_by_side(spark, plain_store):
    """A thread that has started its stream does not take the store away from another that is about to."""
    left, seen = threading.Event(), []

    def other():
        with runs.keyed_state(spark):
            left.wait(60)
            seen.append(spark.conf.get(runs.PROVIDER))

    thread = threading.Thread(target=other)
    with runs.keyed_state(spark):
        thread.start()
        thread.join(2)  # without turns it is inside by now
    left.set()
    thread.join(60)
    assert seen == [runs.ROCKSDB] and spark.conf.get(runs.PROVIDER) == runs.PLAIN


def test_retention_of_records_without_place_or_hour(spark, tmp_path):
    """A product without any hour has nothing to retain; records without a place are one place more."""
    schema, path = "product string, place long, hour_us long", str(tmp_path / "products")
    spark.createDataFrame([("clouds", None, 5), ("clouds", None, 7), ("clouds", 0, 3), ("clouds", 1, None), ("clouds", 2, 9), ("clouds", 2, None)],
                          schema).coalesce(1).write.parquet(path)
    _, checkpoint = runs.run_available(observations.retained_stream(sources.file_stream(spark, path, schema), {"clouds": 24.0}), "update")
    held = runs.stored_state(spark, checkpoint, "clouds").select("key.place", "key.known", "value.value.hour_us").collect()
    assert sorted(map(tuple, held)) == [(0, False, 7), (0, True, 3), (2, True, 9)]


def test_absent_waits_end_runs(spark, tmp_path):
    """A run ended by an absent wait comes out when a fast one has come, and is held until then."""
    day = 86_400
    waits = [(k, day + i, None if w == "?" else w == "s") for k, all_ in (("a", "sss?ssf?sss"), ("b", "sss?ssss?s"), ("c", "???")) for i, w in enumerate(all_)]
    rows = spark.createDataFrame(waits, "key string, s long, slow boolean").select(
        "key", F.timestamp_seconds("s").alias("time"), (F.col("s") * 1_000_000).alias("t_us"), F.col("s").alias("event_id"), "slow")
    rows.coalesce(1).write.parquet(str(tmp_path / "waits"))
    out, checkpoint = runs.run_closed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "waits")), "time", telemetry.slow_run_stream)
    us = lambda i: (day + i) * 1_000_000
    assert sorted(map(tuple, out.collect())) == [("a", 3, us(0), us(2))]
    state = runs.stored_state(spark, checkpoint, "state").select("key.key", "value.*").collect()
    assert sorted(map(tuple, state)) == [("a", 3, us(8), us(10), []), ("b", 1, us(9), us(9), [3, us(0), us(2), 4, us(4), us(7)])]
