"""Aurora: grids, the strongest dark place, and where to look from."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bearing_to, destination, unit_vector
from ..functions.numeric import clip
from ..operators.grids import dense_grid
from ..operators.regrid import resize

GRID = "grid_id"


def strongest_dark_cell(bands: DataFrame, alpha: str, sun: Column, height: int, width: int, n: int = 4) -> DataFrame:
    """Per grid the brightest n x n block with |lat| 45-85 and the Sun at least 10 degrees down; first on ties."""
    blocks = bands.groupBy(GRID, F.floor(F.col("y") / n).cast("int").alias("by"), F.floor(F.col("x") / n).cast("int").alias("bx")) \
        .agg(F.sum(alpha).alias("total"))
    lat = 90.0 - (F.col("by") * n + n / 2) * (180.0 / height)
    lon = -180.0 + (F.col("bx") * n + n / 2) * (360.0 / width)
    placed = blocks.withColumns({"lat": lat, "lon": lon, "sun": sun})
    up = unit_vector("lat", "lon")
    cosine = up[0] * F.col("sun")[0] + up[1] * F.col("sun")[1] + up[2] * F.col("sun")[2]
    dark = placed.where(F.abs("lat").between(45.0, 85.0) & (cosine <= -math.sin(math.radians(10.0))))
    best = dark.groupBy(GRID).agg(F.max_by(F.struct("lat", "lon", "total"), F.struct("total", -F.col("by"), -F.col("bx"))).alias("b"))
    return best.select(GRID, "b.lat", "b.lon", (F.col("b.total") / (n * n * 255.0)).alias("probability"))


# Bearings of the candidate places, and the sampled directions and reaches of their horizon.
BEARINGS = tuple(30.0 * k for k in range(12))
OFFSETS, REACHES = (-35.0, -15.0, 0.0, 15.0, 35.0), (21.0, 26.0)


def vantage(targets: DataFrame, key: str) -> DataFrame:
    """Per target (lat, lon, arc in degrees, sun vector) the place on the circle round it with the darkest horizon.

    The score is the highest Sun over the horizon samples, not under -0.2, plus a small cost for going
    poleward; the first bearing wins ties. Candidates are reduced to one row per target before the shuffle.
    """
    t = targets.withColumns({"_la": F.radians("lat"), "_lo": F.radians("lon"), "_d": F.radians("arc")})
    t = t.withColumn("_c", F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(math.radians(b)).alias("b")) for i, b in enumerate(BEARINGS)])))
    end_lat, end_lon, _ = destination(F.col("_la"), F.col("_lo"), F.col("_c.b"), F.col("_d"))
    t = t.withColumns({"_clat": end_lat, "_clon": end_lon})
    t = t.withColumn("_heading", bearing_to(F.col("_clat"), F.col("_clon"), F.col("_la"), F.col("_lo")))
    samples = []
    for off in OFFSETS:
        for reach in REACHES:
            la, lo, _ = destination(F.col("_clat"), F.col("_clon"), F.col("_heading") + math.radians(off), F.lit(math.radians(reach)))
            samples.append(F.cos(la) * F.cos(lo) * F.col("sun")[0] + F.cos(la) * F.sin(lo) * F.col("sun")[1] + F.sin(la) * F.col("sun")[2])
    score = F.greatest(F.lit(-0.2), *samples) + 0.002 * F.degrees(F.abs("_clat") - F.abs("_la"))
    t = t.withColumn("score", score)
    best = t.groupBy(key).agg(F.min_by(
        F.struct(F.col("_c.step").alias("step"), "score", "_clat", "_clon", "_heading"),
        F.struct(F.round("score", 9), F.col("_c.step"))).alias("b"))
    lon = F.pmod(F.degrees("b._clon") + 540.0, F.lit(360.0)) - 180.0
    return best.select(key, "b.step", "b.score", F.degrees("b._clat").alias("camera_lat"), lon.alias("camera_lon"),
                       F.pmod(F.degrees("b._heading"), F.lit(360.0)).alias("heading"))


def aurora_grid(points: DataFrame, key: str, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Integer-degree probabilities (key, lon, lat, value 0-100) as bytes on the target grid.

    Rows run north to south; columns are turned by half the width so that -180 comes first.
    Nodes that are not listed count as 0.
    """
    h, w = source
    placed = points.select(
        F.col(key).alias(GRID), ((h - 1) // 2 - F.col("lat")).cast("int").alias("y"),
        F.pmod(F.col("lon") + w // 2, F.lit(w)).cast("int").alias("x"), (F.col("value") / 100.0).alias("p"))
    # Skipped without normalising, a missing node adds nothing to the weighted sums, as one of value 0 would.
    big = resize(placed, ["p"], source, target, "bilinear", missing="skip")
    full = dense_grid(placed.select(GRID).distinct(), *target)
    big = full.join(big, [GRID, "y", "x"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return big.select(GRID, "y", "x", F.rint(F.round(clip("p", 0.0, 1.0) * 255.0, 6)).cast("int").alias("alpha"))
