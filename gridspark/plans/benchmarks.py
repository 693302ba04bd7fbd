"""Before/after comparison of benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import neighbour, running
from ..operators.quantiles import exact_percentiles


def match_runs(before: DataFrame, after: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """(keys, verdict): pairs whose context agrees, pairs where it differs, and keys of one side only."""
    a = before.select(*keys, *[F.col(c).alias("_a_" + c) for c in same], F.lit(1).alias("_a"))
    b = after.select(*keys, *[F.col(c).alias("_b_" + c) for c in same], F.lit(1).alias("_b"))
    verdict = F.when(F.col("_b").isNull(), "only before").when(F.col("_a").isNull(), "only after")
    for c in same:
        verdict = verdict.when(~F.col("_a_" + c).eqNullSafe(F.col("_b_" + c)), f"{c} differ")
    return a.join(b, keys, "full_outer").select(*keys, verdict.otherwise("pair").alias("verdict"))


def scene_summary(samples: DataFrame, by: list[str], value: str, time: str, order: list[str]) -> DataFrame:
    """Per scene: samples, median, last value by time, and change over elapsed seconds."""
    first_key, last_key = F.struct(time, *order), F.struct(time, *order)
    stats = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.max_by(value, last_key).alias("last"), F.min_by(value, first_key).alias("first"),
        ((F.max(time) - F.min(time)) / 1e6).alias("seconds"))
    medians = exact_percentiles(samples, by, value, {"median": 0.5})
    rate = F.when(F.col("seconds") > 0, (F.col("last") - F.col("first")) / F.col("seconds"))
    return stats.join(medians, by).withColumn("rate", rate)


def slow_runs(waits: DataFrame, by: list[str], order: list[str], slow: Column, chunk_width: float,
              least: int = 3) -> DataFrame:
    """Runs of at least ``least`` slow waits in a row; a fast one ends a run.

    A run is numbered by the fast waits before it, so its length is a plain count.
    """
    tagged = running(waits.withColumn("_slow", slow), by, order, chunk_width,
                     {"_run": ("sum", F.when(F.col("_slow"), 0).otherwise(1))})
    runs = tagged.where("_slow").groupBy(*by, "_run").agg(
        F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("start"), F.max(order[0]).alias("end"))
    return runs.where(F.col("length") >= least).drop("_run")


def ab_summary(samples: DataFrame, value: str) -> DataFrame:
    """Mean before, after and reduction in percent per scene and in total, and the runs that were seen there."""
    wide = samples.cube("scene").agg(
        F.avg(F.when(F.col("run") == "before", F.col(value))).alias("before"),
        F.avg(F.when(F.col("run") == "after", F.col(value))).alias("after"),
        F.array_join(F.array_sort(F.collect_set("run")), ",").alias("runs"),  # a few labels
        F.count(F.lit(1)).alias("samples"), F.grouping("scene").cast("int").alias("total"))
    return wide.withColumn("reduction", F.when(F.col("before") != 0, (1.0 - F.col("after") / F.col("before")) * 100.0))


def frame_rate(frames: DataFrame, by: list[str], time: str, step_us: int) -> DataFrame:
    """Frames per second in fixed windows."""
    start = F.col(time) - F.pmod(F.col(time), F.lit(step_us))
    return frames.groupBy(*by, start.alias("window_us")).agg(F.count(F.lit(1)).alias("frames")) \
        .withColumn("rate", F.round(F.col("frames") / (step_us / 1e6), 6))
