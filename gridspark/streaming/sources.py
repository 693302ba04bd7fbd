"""File streams of the domain frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
