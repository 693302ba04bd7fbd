"""Generations: write everything under a fresh name, then append one entry to a numbered log."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = "_log"


class Taken(Exception):
    """Another writer has put an entry under the same number."""


def publish(df: DataFrame, root: str, gen: str, partitions: list[str] | None = None) -> str:
    """Write one generation and then log it.

    A generation exists once its entry does: a write that fails, before or between the steps, leaves readers the last
    good one. A generation that is in the log is not written again, so a repeated micro-batch changes nothing, and one that
    is not is written over what a broken attempt has left.
    """
    spark = df.sparkSession
    if any(e["gen"] == gen for e in entries(spark, root)):
        return gen
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(f"{root}/gen={gen}")
    while True:
        try:
            append(spark, root, {"gen": gen})
            return gen
        except Taken:
            if any(e["gen"] == gen for e in entries(spark, root)):
                return gen


def _files(spark: SparkSession, root: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{LOG}")
    return jvm, conf, path, path.getFileSystem(conf)


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the log, ascending."""
    _, _, path, fs = _files(spark, root)
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def append(spark: SparkSession, root: str, entry: dict, number: int | None = None) -> int:
    """Put ``entry`` under ``number`` (default: the next one), if that is free; else raise ``Taken``.

    The entry is written whole under another name and then renamed, which the file system refuses where the number exists. So
    of two writers one gets the number, and no reader sees half an entry.
    """
    jvm, conf, path, fs = _files(spark, root)
    if number is None:
        number = (numbers(spark, root) or [-1])[-1] + 1
    fs.mkdirs(path)
    fresh = jvm.org.apache.hadoop.fs.Path(path, f".{uuid.uuid4().hex}.tmp")
    final = jvm.org.apache.hadoop.fs.Path(path, f"{number:020d}.json")
    out = fs.create(fresh, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf).rename(
            fs.makeQualified(fresh), fs.makeQualified(final), keep)
    except Exception as error:
        fs.delete(fresh, False)
        if fs.exists(final):
            raise Taken(str(final)) from error
        raise
    return number


def entry(spark: SparkSession, root: str, number: int) -> dict:
    jvm, _, path, fs = _files(spark, root)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, f"{number:020d}.json"))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def entries(spark: SparkSession, root: str) -> list[dict]:
    """All entries in order; one short line a generation."""
    return [entry(spark, root, n) for n in numbers(spark, root)]


def current(spark: SparkSession, root: str) -> str | None:
    """The generation of the last entry."""
    known = numbers(spark, root)
    return entry(spark, root, known[-1])["gen"] if known else None


def read_generation(spark: SparkSession, root: str, gen: str | None = None) -> DataFrame:
    """A pinned generation, or the last one that was logged. The pinned name never moves."""
    gen = gen or current(spark, root)
    if gen is None:
        raise FileNotFoundError(f"{root} has no generation")
    return spark.read.parquet(f"{root}/gen={gen}")


def publish_batch(root: str, partitions: list[str] | None = None):
    """A ``foreachBatch`` function that publishes every micro-batch under its batch number."""
    def write(batch: DataFrame, batch_id: int) -> None:
        publish(batch, root, f"{batch_id:012d}", partitions)
    return write
