"""Attempts that a minimum gap lets through, in order of time: an attempt that was made starts the wait, others do not.

Every attempt has a pointer to the next one allowed after it, the first at least ``gap`` later; the attempts made are those
that pointers reach from the first of a key. The chain of a key may be as long as its attempts, so it is contracted: a
key is cut into chunks along time, chains are followed inside a chunk to their last attempt there, and only pointers from
chunk to chunk are left. Doubling these pointers marks the chunks' entries in as many rounds as the logarithm of the
number of chunks, and each chunk then walks on from its entry. No key is in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .asof import asof_join
from .ordered import CHUNK, with_chunk


def next_allowed(times: np.ndarray, gap: int) -> np.ndarray:
    """For each of the ascending times the place of the first that is ``gap`` later; their number where there is none."""
    return np.searchsorted(times, times + gap, "left")


def chain_ends(times: np.ndarray, gap: int) -> np.ndarray:
    """The last time of the chain that starts at each time, by doubling the pointers."""
    n = len(times)
    ahead = next_allowed(times, gap)
    ahead = np.where(ahead == n, np.arange(n), ahead)
    while True:
        further = ahead[ahead]
        if np.array_equal(further, ahead):
            return times[ahead]
        ahead = further


def chain_from(times: np.ndarray, start: int, gap: int) -> np.ndarray:
    """The times of the chain that starts at the first time not before ``start``."""
    ahead, out = next_allowed(times, gap).tolist(), []
    at = int(np.searchsorted(times, start, "left"))
    while at < len(times):
        out.append(at)
        at = ahead[at]
    return times[out]


def throttled(attempts: DataFrame, by: list[str], time: str, order: list[str], gap_us: int, chunk_width: float | None = None) -> DataFrame:
    """The attempts made: the first of each key, then each first one at least ``gap_us`` after the one made before it.

    Of equal times the first by ``order`` counts. Keys are not NULL; rows without a time are never made.
    ``chunk_width`` is as in ``with_chunk``.
    """
    if gap_us <= 0:
        raise ValueError("the gap is positive")
    rows = attempts.where(F.col(time).isNotNull())
    # Of equal times only the first attempt can be made, so a time of a key is one node.
    nodes = rows.groupBy(*by, F.col(time).cast("bigint").alias("_t")).agg(
        F.min(F.struct(*order)).alias("_first")) if order else rows.groupBy(*by, F.col(time).cast("bigint").alias("_t")).agg(F.lit(0).alias("_first"))
    nodes = with_chunk(nodes, by, ["_t"], chunk_width)
    nodes = cut_lineage(nodes) if chunk_width is not None else nodes
    keys = [*by, CHUNK]
    schema = T.StructType([*(nodes.schema[c] for c in keys), T.StructField("_t", T.LongType()), T.StructField("_last", T.LongType())])

    def ends(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("_t")
        chunk["_last"] = chain_ends(chunk["_t"].to_numpy(), gap_us)
        return chunk[[*keys, "_t", "_last"]]

    chains = cut_lineage(nodes.select(*keys, "_t").groupBy(*keys).applyInPandas(ends, schema))
    # Where the chains of a chunk go on: the first node after the gap, in whichever chunk it lies.
    exits = chains.select(*by, "_last").distinct().withColumn("_from", -(F.col("_last") + gap_us))
    targets = nodes.select(*by, F.col("_t").alias("_to"), (-F.col("_t")).alias("_at"))
    jumps = asof_join(exits, targets, by, "_from", "_at", ["_to"], chunk_width).where(F.col("_to").isNotNull()).select(*by, "_last", "_to")
    first = nodes.groupBy(*by).agg(F.min("_t").alias("_t"))
    entries = first.unionByName(jumps.select(*by, F.col("_to").alias("_t"))).distinct()
    leads = cut_lineage(entries.join(chains, [*by, "_t"]).join(jumps, [*by, "_last"]).select(*by, "_t", "_to"))
    reached, fresh = cut_lineage(first), True
    while fresh:
        new = reached.join(leads, [*by, "_t"]).select(*by, F.col("_to").alias("_t"))
        reached = cut_lineage(reached.unionByName(new).distinct())
        twice = leads.withColumnRenamed("_to", "_mid").join(
            leads.select(*by, F.col("_t").alias("_mid"), "_to"), [*by, "_mid"]).select(*by, "_t", "_to")
        leads = cut_lineage(twice)
        fresh = not leads.isEmpty()
    # A chain enters a chunk once.
    entered = reached.join(chains.select(*keys, "_t"), [*by, "_t"]).select(*keys, F.col("_t").alias("_entry"))
    walked = nodes.select(*keys, "_t").join(entered, keys)
    out = T.StructType([*(nodes.schema[c] for c in by), T.StructField("_t", T.LongType())])

    def walk(chunk: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(chunk["_t"].to_numpy())
        made = chain_from(times, int(chunk["_entry"].iloc[0]), gap_us)
        return pd.DataFrame({**{c: chunk[c].iloc[0] for c in by}, "_t": made})

    made = walked.groupBy(*keys).applyInPandas(walk, out).join(nodes.select(*by, "_t", "_first"), [*by, "_t"])
    named = made.select(*by, F.col("_t").alias(time), *[F.col(f"_first.{c}").alias(c) for c in order])
    return rows.join(named.distinct(), [*by, time, *order], "left_semi").dropDuplicates([*by, time, *order])
