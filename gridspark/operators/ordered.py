"""Ordered scans that hold when one key owns a large share of the rows.

A plain running window puts a whole key into one task. Here every key is cut into chunks along its
order column: rows are scanned inside (key, chunk), each chunk is reduced to one total, and the
totals of earlier chunks are carried in. Only totals are ever ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = "_chunk"


def with_chunk(df: DataFrame, by: list[str], order: list[str], width: float | None) -> DataFrame:
    """Number the chunks of each key.

    With a ``width`` a chunk is a range of the first order column (numeric), found without moving rows: right
    where its values spread over time or ids. Without one, Spark range-partitions the rows on key and full
    order by sampling, and the partition number is the chunk: no burst of equal values makes a chunk large.
    The rows are then written once to the checkpoint folder, so that the numbers stay what they are.
    """
    if width is not None:
        return df.withColumn(CHUNK, F.floor(F.col(order[0]) / F.lit(width)).cast("bigint"))
    return cut_lineage(df.repartitionByRange(*by, *order).withColumn(CHUNK, F.spark_partition_id().cast("bigint")))


_TOTAL = {
    "sum": lambda v, o: F.sum(v),
    "count": lambda v, o: F.count(v),
    "min": lambda v, o: F.min(v),
    "max": lambda v, o: F.max(v),
    "last": lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)),
}
_SCAN = {
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "last": lambda v: F.last(v, ignorenulls=True),
}
_MERGE = {
    "sum": lambda c, v: F.coalesce(c + v, c, v),
    "count": lambda c, v: F.coalesce(c, F.lit(0)) + v,
    "min": lambda c, v: F.least(c, v),
    "max": lambda c, v: F.greatest(c, v),
    "last": lambda c, v: F.coalesce(v, c),
}


def running(df: DataFrame, by: list[str], order: list[str], chunk_width: float | None,
            scans: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Add running ``sum``, ``count``, ``min``, ``max`` or ``last`` (non-null) columns.

    ``order`` must be unique per key; ``chunk_width`` is as in ``with_chunk``. ``scans`` maps an
    output name to (kind, value). ``inclusive`` counts the row itself, else only the rows before it.
    """
    columns = df.columns
    df = df.withColumns({"_v_" + name: value for name, (_, value) in scans.items()})
    df = with_chunk(df, by, order, chunk_width)
    keys = [*by, CHUNK]
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    position = F.struct(*order)
    totals = df.groupBy(*keys).agg(*[
        _TOTAL[kind](F.col("_v_" + name), position).alias("_t_" + name) for name, (kind, _) in scans.items()])
    before = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, *[
        (F.sum("_t_" + name) if kind == "count" else _SCAN[kind](F.col("_t_" + name))).over(before).alias("_c_" + name)
        for name, (kind, _) in scans.items()])
    local = df.select("*", *[
        _SCAN[kind](F.col("_v_" + name)).over(rows).alias("_l_" + name) for name, (kind, _) in scans.items()])
    return local.join(carry, keys, "left").select(*columns, *[
        _MERGE[kind](F.col("_c_" + name), F.col("_l_" + name)).alias(name) for name, (kind, _) in scans.items()])


def neighbour(df: DataFrame, by: list[str], order: list[str], chunk_width: float | None,
              values: dict[str, Column], offset: int = 1) -> DataFrame:
    """Add values of the next row (``offset`` 1) or the previous one (-1), across chunk edges."""
    if offset not in (1, -1):
        raise ValueError("offset is 1 or -1")
    columns = df.columns
    packed = F.struct(*[v.alias(name) for name, v in values.items()])
    df = with_chunk(df.withColumn("_v", packed), by, order, chunk_width)
    keys = [*by, CHUNK]
    position = F.struct(*order)
    rows = Window.partitionBy(*keys).orderBy(*order)
    edge = F.min_by if offset == 1 else F.max_by
    edges = df.groupBy(*keys).agg(edge("_v", position).alias("_edge"))
    chunks = Window.partitionBy(*by).orderBy(CHUNK)
    step = F.lead if offset == 1 else F.lag
    carry = edges.select(*keys, step("_edge").over(chunks).alias("_carry"))
    local = df.withColumn("_near", step("_v").over(rows))
    near = F.coalesce("_near", "_carry")
    return local.join(carry, keys, "left").select(*columns, *[near[name].alias(name) for name in values])


def global_order(df: DataFrame, order: list[Column | str], sums: dict[str, Column] | None = None,
                 rank: str = "rank") -> DataFrame:
    """Add a 1-based rank over the whole table, and running sums, without a one-task window.

    The rows are range-partitioned by Spark on the (unique) order, written once to the checkpoint
    folder so the partition numbers are fixed, ranked inside their partition, and shifted by the
    totals of the earlier partitions, of which there are as many as partitions.
    """
    sums = sums or {}
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.withColumns({"_s_" + n: v for n, v in sums.items()}) if sums else df
    ranged = cut_lineage(ranged.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum("_s_" + n).alias("_t_" + n) for n in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        *[F.coalesce(F.sum("_t_" + n).over(before), F.lit(0)).alias("_base_" + n) for n in sums])
    within = Window.partitionBy("_part").orderBy(*order)
    out = ranged.withColumn(rank, F.row_number().over(within))
    for n in sums:
        out = out.withColumn(n, F.sum("_s_" + n).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(base), "_part").withColumn(rank, F.col(rank) + F.col("_base"))
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.col("_base_" + n))
    return out.drop("_part", "_base", *["_s_" + n for n in sums], *["_base_" + n for n in sums])
