"""Packed texel rows and pyramid tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tiles as T

GRID = "grid_id"


def export_bgra(cells: DataFrame, bands: list[str]) -> DataFrame:
    """(grid, y, payload, sha256): byte bands as B, G, R, A texels, one row of the image per row.

    One band is repeated into three, and alpha is 255 unless there are four. A row of an image is the
    largest unit ever gathered.
    """
    order = [bands[0]] * 3 if len(bands) == 1 else [bands[2], bands[1], bands[0]]
    alpha = F.col(bands[3]) if len(bands) == 4 else F.lit(255)
    texel = F.concat(*[F.lpad(F.hex(F.col(b).cast("int")), 2, "0") for b in order], F.lpad(F.hex(alpha.cast("int")), 2, "0"))
    rows = cells.groupBy(GRID, "y").agg(F.array_sort(F.collect_list(F.struct("x", texel.alias("t")))).alias("s"))
    payload = F.unhex(F.array_join(F.transform("s", lambda v: v["t"]), ""))
    return rows.select(GRID, "y", F.size("s").alias("w"), payload.alias("payload"), F.sha2(payload, 256).alias("sha256"))


def sidecar(rows: DataFrame) -> DataFrame:
    """Extent and byte counts per image."""
    return rows.groupBy(GRID).agg(F.max("w").alias("width"), F.count(F.lit(1)).alias("height"),
                                  F.sum(F.octet_length("payload").cast("bigint")).alias("payload_bytes"))


def write_pyramid(tiles: DataFrame, path: str) -> None:
    """Tiles in canonical order: range-partitioned and sorted by key, so a read of a level is contiguous."""
    tiles.repartitionByRange(*T.KEY).sortWithinPartitions(*T.KEY).write.mode("overwrite").parquet(path)
