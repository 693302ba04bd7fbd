"""Runs of a stream over what is there, with results and state on the shared folder."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_root

# A time after all data; one row there lets the watermark pass everything before it.
CLOSING = "2200-01-01 00:00:00"

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PLAIN, ROCKSDB = (f"org.apache.spark.sql.execution.streaming.state.{c}StateStoreProvider" for c in ("HDFSBacked", "RocksDB"))


PARTITIONS = "spark.sql.shuffle.partitions"

_SETTINGS = threading.Lock()


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB where the session has Spark's default store, a part a core.

    That store has no column families, which processors of keyed state need; any other store that the submitter chose
    stays. Every part of the state is a store of its own, which each batch opens and commits once for all its rows, and
    beside it a Python worker; more parts than cores make a run longer and let no more of it run at once. A query takes
    the settings over when it starts, so the session gets its own back. Queries that threads of one session start side by
    side wait for each other here: one would else give the session's store back before the other has started.
    """
    with _SETTINGS:
        store, parts = spark.conf.get(PROVIDER, PLAIN), spark.conf.get(PARTITIONS)
        spark.conf.set(PROVIDER, ROCKSDB if store == PLAIN else store)
        spark.conf.set(PARTITIONS, str(min(int(parts), spark.sparkContext.defaultParallelism)))
        try:
            yield
        finally:
            spark.conf.set(PROVIDER, store)
            spark.conf.set(PARTITIONS, parts)


def _once(df: DataFrame, root: str, mode: str) -> None:
    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
    if mode == "append":
        query = query.trigger(availableNow=True).format("parquet").option("path", f"{root}/out")
    else:  # state by processing time always wants another batch, so the run is one batch
        query = query.trigger(once=True).format("noop")
    with keyed_state(df.sparkSession):
        run = query.start()
    run.awaitTermination()


def run_available(df: DataFrame, mode: str = "append") -> tuple[DataFrame | None, str]:
    """Run a stream through what is there: its results (append mode) and the folder of its checkpoint."""
    root = f"{checkpoint_root(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    _once(df, root, mode)
    spark = df.sparkSession
    return (spark.read.schema(df.schema).parquet(f"{root}/out") if mode == "append" else None), f"{root}/checkpoint"


def run_closed(source: DataFrame, time: str, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """Run ``build(source)`` through what is there, then close it by one row after all times, so that all state is released.

    The closing row has NULL in all other columns; it comes in a second run of the same query, when every file of the
    source has been read, so no row is late because of it. ``build`` sets the watermark on ``time`` and should drop or
    withhold rows without a key.
    """
    spark = source.sparkSession
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    _rows(spark, source.schema, time, 0).write.parquet(f"{root}/closing")
    closing = spark.readStream.schema(source.schema).parquet(f"{root}/closing")
    result = build(source.unionByName(closing))
    _once(result, root, "append")
    _rows(spark, source.schema, time, 1).write.mode("append").parquet(f"{root}/closing")
    _once(result, root, "append")
    return spark.read.schema(result.schema).parquet(f"{root}/out"), f"{root}/checkpoint"


def _rows(spark: SparkSession, schema: StructType, time: str, n: int) -> DataFrame:
    return spark.range(n).select(*[
        (F.lit(CLOSING).cast(f.dataType) if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def stored_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """(key, value) of one state variable after the last batch of a query."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select("key", "value")
