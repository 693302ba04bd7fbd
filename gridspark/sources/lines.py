"""Text files as numbered lines, long files in byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, line_no, line), blank lines included, numbered from 0 in each file.

    Spark reads a long file by several tasks, each a range of its bytes. A line is known by the start of its range and
    its order in the task, so it is numbered inside its range, and the counts of the earlier ranges of its file, one row
    a range, are added.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("_range"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    first = raw.groupBy("file_id", "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = first.select("file_id", "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return raw.join(base, ["file_id", "_range"]).select("file_id", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")
