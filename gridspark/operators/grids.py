"""Dense target grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense_grid(keys: DataFrame, height: int, width: int) -> DataFrame:
    """Every (y, x) of a grid for each key row, made on the executors."""
    rows = keys.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
