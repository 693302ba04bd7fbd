"""Session helpers: what the library needs from Spark, and nothing machine-local."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound for a side that the library itself marks for broadcast.
BROADCAST_ROW_LIMIT = 500_000


def build_session(name: str = "gridspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    Cluster sizing (executors, memory, shuffle partitions) stays with the submitter; adaptive
    execution coalesces small shuffles and splits skewed join partitions at run time.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    On a cluster it is the folder named in ``spark.checkpoint.dir``. Only where nothing is set,
    and only in local mode, is a temporary folder chosen.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast when ``rows``, its proven row bound, is small enough.

    Above the limit the frame is returned unmarked, and the join runs as a shuffle join.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROW_LIMIT else df


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed values (axis weights, sectors, enumerations), broadcast when small.

    ``schema`` is ``name type, ...``. The rows travel as Arrow and become a local relation of the plan,
    so no job runs to make them.
    """
    fields = [f.split() for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    table = pa.table({name: pa.array(values, _ARROW[kind]) for (name, kind), values in zip(fields, columns)})
    return small(spark.createDataFrame(table), len(rows))
