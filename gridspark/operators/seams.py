"""Sectors of the five-satellite mosaic and the balance of brightness across their seams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import literal_table
from .kernels import bartlett, sliding_median

GRID = "grid_id"
# Sub-satellite longitudes, degrees east.
SATELLITES = (-137.0, -75.2, 0.0, 45.5, 140.7)
# Strip of four columns that starts two columns from a seam.
STRIP_START, STRIP = 2, 4


def seam_lons() -> list[float]:
    """Longitudes midway between neighbouring satellites, round the globe."""
    ring = list(SATELLITES) + [SATELLITES[0] + 360.0]
    return [(a + b) / 2.0 for a, b in zip(ring, ring[1:])]


def seam_columns(width: int) -> list[int]:
    """Nominal first column east of each seam."""
    return [round((lon + 180.0) * width / 360.0) % width for lon in seam_lons()]


def sector_of(lon: Column) -> Column:
    """Index of the nearest satellite on the circle, the first on ties."""
    def away(s):
        d = F.abs(lon - s)
        return F.least(d, 360.0 - d)
    gaps = F.array(*[F.struct(away(s).alias("d"), F.lit(i).alias("i")) for i, s in enumerate(SATELLITES)])
    return F.array_min(gaps)["i"]


def locate_seams(cells: DataFrame, band: str, width: int, radius: int = 3, min_rows: int = 60) -> DataFrame:
    """(grid, seam, start): the column within ``radius`` of the nominal one where neighbours differ most.

    Medians over the rows of one grid; too few rows count as no jump, ties keep the first candidate,
    and no jump at all keeps the nominal column. Only the candidate columns are read.
    """
    rows = []
    for seam, nominal in enumerate(seam_columns(width)):
        for order in range(2 * radius + 1):
            c = (nominal + order - radius) % width
            rows += [(c, seam, order, c, nominal, 1), ((c - 1) % width, seam, order, c, nominal, 0)]
    table = literal_table(cells.sparkSession, rows, "_x int, seam int, ord int, cand int, nominal int, east int")
    near = cells.select(GRID, "y", "x", band).join(table, cells["x"] == table["_x"])
    pairs = near.groupBy(GRID, "seam", "ord", "cand", "nominal", "y").agg(
        F.abs(F.max(F.when(F.col("east") == 1, F.col(band))) - F.max(F.when(F.col("east") == 0, F.col(band)))).alias("d"))
    jumps = pairs.groupBy(GRID, "seam", "ord", "cand", "nominal").agg(
        F.when(F.count("d") >= min_rows, F.median("d")).otherwise(F.lit(0.0)).alias("jump"))
    best = jumps.groupBy(GRID, "seam", "nominal").agg(
        F.max("jump").alias("_j"), F.max_by("cand", F.struct("jump", -F.col("ord"))).alias("_c"))
    return best.select(GRID, "seam", F.when(F.col("_j") > 0, F.col("_c")).otherwise(F.col("nominal")).alias("start"))


def seam_steps(cells: DataFrame, band: str, starts: DataFrame, width: int, minimum: int = 2) -> DataFrame:
    """(grid, seam, y, step): mean of the strip east of each seam less the one west of it.

    Each side needs ``minimum`` valid columns, else the step is missing.
    """
    offsets = F.array(*[F.struct(F.lit(1).alias("east"), F.lit(STRIP_START + k).alias("o")) for k in range(STRIP)],
                      *[F.struct(F.lit(0).alias("east"), F.lit(-1 - STRIP_START - k).alias("o")) for k in range(STRIP)])
    want = starts.withColumn("_o", F.explode(offsets)).select(
        GRID, "seam", F.col("_o.east").alias("east"), F.pmod(F.col("start") + F.col("_o.o"), F.lit(width)).alias("x"))
    strips = cells.select(GRID, "y", "x", band).join(want, [GRID, "x"])

    def side(flag):
        v = F.when(F.col("east") == flag, F.col(band))
        return F.when(F.count(v) >= minimum, F.avg(v))
    return strips.groupBy(GRID, "seam", "y").agg((side(1) - side(0)).alias("step"))


def seam_offsets(steps: DataFrame, height: int, window_degrees: float = 1.6, limit: float = 0.5) -> DataFrame:
    """(grid, seam, y, offset): the steps after sliding median, support gate, clip and smoothing."""
    half = max(1, round(window_degrees * height / 180.0))
    gated = sliding_median(steps, [GRID, "seam"], "y", "step", half, max(3, half), limit, "_m")
    return bartlett(gated, [GRID, "seam"], "y", "_m", half, "offset").select(GRID, "seam", "y", "offset")


def apply_offsets(cells: DataFrame, band: str, offsets: DataFrame, starts: DataFrame, width: int,
                  reach_degrees: float = 20.0) -> DataFrame:
    """Take each offset from the brighter side, fading to nothing over ``reach_degrees``.

    The tapers of neighbouring seams can overlap, so the corrections of a cell are summed. The offsets of
    all seams are laid side by side per (grid, row), one row for a whole row of cells, and the taper is an
    expression of the distance to each seam.
    """
    reach = max(1, round(reach_degrees * width / 360.0))
    sides = offsets.join(starts, [GRID, "seam"])
    seams = range(len(SATELLITES))
    rows = sides.groupBy(GRID, "y").agg(*[
        F.max(F.when(F.col("seam") == i, F.struct("start", "offset"))).alias(f"_s{i}") for i in seams])

    def taper(k):
        return F.when(k < reach, 0.5 * (1.0 + F.cos(math.pi * (k + 0.5) / reach))).otherwise(F.lit(0.0))

    total = F.lit(0.0)
    for i in seams:
        start, offset = F.col(f"_s{i}.start"), F.col(f"_s{i}.offset")
        part = F.when(offset > 0, offset * taper(F.pmod(F.col("x") - start, F.lit(width)))) \
            .when(offset < 0, -offset * taper(F.pmod(start - 1 - F.col("x"), F.lit(width))))
        total = total + F.coalesce(part, F.lit(0.0))
    out = cells.join(rows, [GRID, "y"], "left")
    return out.withColumn(band, F.col(band) - total).drop(*[f"_s{i}" for i in seams])


def balance(cells: DataFrame, band: str, height: int, width: int) -> DataFrame:
    """The whole seam balance of one band. Corrections all come from the field as it was."""
    starts = locate_seams(cells, band, width)
    steps = seam_steps(cells, band, starts, width)
    return apply_offsets(cells, band, seam_offsets(steps, height), starts, width)
