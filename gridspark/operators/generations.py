"""Retention of generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(files: DataFrame, keep: int) -> DataFrame:
    """(product, gen, rank) of the newest ``keep`` generations.

    Files are reduced to generations first; the rank filter lets Spark keep the top few per partition
    before the shuffle.
    """
    gens = files.select("product", "gen_us").distinct()
    rank = F.row_number().over(Window.partitionBy("product").orderBy(F.desc("gen_us")))
    return gens.withColumn("rank", rank).where(F.col("rank") <= keep)


def obsolete(files: DataFrame, retained: DataFrame, owned: list[str], required: list[str], keep: int = 2,
             preview: str = "preview") -> DataFrame:
    """(product, gen) that may be removed.

    Everything but the newest ``keep`` plus every preview, less the retained ones, and only where the
    names hold the required files and nothing that is not owned. ``preview`` is a boolean column.
    """
    names = F.col("name")
    gens = files.groupBy("product", "gen_us").agg(
        F.bool_or(F.col(preview)).alias("_preview"), F.bool_and(names.isin(owned)).alias("_own"),
        *[F.bool_or(names == r).alias(f"_has{i}") for i, r in enumerate(required)])
    newest = latest(files.where(~F.col(preview)), keep)
    old = gens.where(~F.col("_preview")).join(newest, ["product", "gen_us"], "left_anti")
    candidates = old.unionByName(gens.where("_preview"))
    whole = F.col("_own")
    for i in range(len(required)):
        whole = whole & F.col(f"_has{i}")
    return (candidates.where(whole).join(retained.select("product", "gen_us").distinct(), ["product", "gen_us"], "left_anti")
            .select("product", "gen_us"))
