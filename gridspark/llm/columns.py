"""Shared helpers: columns computed from Arrow batches, fold tests and tables on the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root

# Characters of text that one step of a numpy kernel takes; a longer text is a step by itself.
STEP_CHARS = 1 << 20
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def steps(texts: list[str | None], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a batch whose texts sum to about ``limit`` characters, so that kernels need bounded memory."""
    start = total = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def bounded_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to BATCH_ROWS, if the session allows more.

    A batch stands in memory several times, in the executor and in its Python worker, and rows of text are long.
    """
    if int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def handing_back(run: Callable) -> Callable:
    """``run`` over Arrow batches; what it no longer uses goes back to the system after each batch and at its end.

    Workers stay for later tasks, and an allocator keeps what it once had.
    """
    def lent(batches):
        for batch in run(batches):
            yield batch
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return lent


def computed(df: DataFrame, inputs: list[str | Column], outputs: list[T.StructField],
             make: Callable[[], Callable[..., list]], keep: list[str] | None = None) -> DataFrame:
    """Append columns computed in Python from Arrow batches.

    ``make`` runs once per task and returns a function of the input columns (as lists) giving one list per output.
    ``keep`` names the columns to carry (default: all). A carried column whose name equals an output, in any
    case, is replaced by the output.
    """
    bounded_batches(df.sparkSession)
    names = {f.name.lower() for f in outputs}
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    hidden = [f"__llm_in{i}" for i in range(len(inputs))]
    source = df.select(*[F.col(f"`{c}`") for c in carried],
                       *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(h) for c, h in zip(inputs, hidden)])
    schema = T.StructType([source.schema[c] for c in carried] + outputs)
    kinds = [_ARROW[f.dataType.simpleString()] for f in outputs]

    def run(batches):
        function = make()
        for batch in batches:
            columns = [batch.column(len(carried) + i).to_pylist() for i in range(len(hidden))]
            made = [pa.array(x, type=k) for x, k in zip(function(*columns), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(carried)], *made],
                                             names=[*carried, *(f.name for f in outputs)])

    return source.mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
          "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
          "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; NULL for a NULL key."""
    return F.crc32(F.col(f"`{key}`").cast("string")) % parts


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and continue from the files.

    The columns stay columnar, so later jobs read only what they use, and a lost executor costs nothing.
    """
    path = f"{checkpoint_root(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
