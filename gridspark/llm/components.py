"""Connected components of a graph of any size: alternating large-star and small-star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import shared_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its least neighbour (or itself) to its larger neighbours."""
    both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the least of them; edges go from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component_id) of every node with a link to another; component_id is the least node reachable.

    Links are undirected; repeated links, self-links and links with NULL change nothing. Each round is written to
    the shared folder; their number grows with the logarithm of the longest chain.
    """
    now = shared_table(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
                       .where(f"`{left}` is not null and `{right}` is not null and u > v").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20)")).alias("h")).first()
        if state == seen or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(
                now.select("v", "v").distinct())
        seen = state
        for step in (_large_star, _small_star):
            now = step(now).where("u > v").distinct()
        now = shared_table(now)
