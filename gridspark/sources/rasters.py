"""Named raster tiles decoded to cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tile letters run west to east, tile numbers north to south.
LETTERS, ROWS = "ABCD", 2


def tile_places(spark) -> DataFrame:
    """(name, row, col) of the eight named tiles."""
    return spark.createDataFrame([(f"{c}{r + 1}", r, i) for i, c in enumerate(LETTERS) for r in range(ROWS)],
                                 "name string, row int, col int")


def tile_name(path) -> F.Column:
    """The tile name in a file path, as in ``world.200409.A1.png``."""
    return F.regexp_extract(path, r"(?:^|[._/-])([A-D][12])(?:[._/-]|$)", 1)


def decode_tiles(tiles: DataFrame, height: int, width: int, channels: int) -> DataFrame:
    """Cells of raw-texel payloads (key, name, payload); an alpha channel is dropped.

    One tile is decoded at a time inside its task; a payload of the wrong size gives no cells and is
    reported by ``bad_payloads``.
    """
    good = tiles.where(F.octet_length("payload") == height * width * channels)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.divmod(np.arange(height * width), width)
        for batch in batches:
            for key, name, payload in zip(batch["key"], batch["name"], batch["payload"]):
                texels = np.frombuffer(payload, np.uint8).reshape(-1, channels)
                yield pd.DataFrame({"key": key, "name": name, "y": y.astype("int32"), "x": x.astype("int32"),
                                    "r": texels[:, 0].astype("int32"), "g": texels[:, 1].astype("int32"),
                                    "b": texels[:, 2].astype("int32")})

    return good.select("key", "name", "payload").mapInPandas(
        decode, "key bigint, name string, y int, x int, r int, g int, b int")


def bad_payloads(tiles: DataFrame, height: int, width: int, channels: int) -> DataFrame:
    return tiles.where(F.octet_length("payload") != height * width * channels).select(
        "key", "name", F.lit("payload size").alias("rule"))
