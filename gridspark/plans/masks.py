"""Quality and surface masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col

# The count that means missing, per product.
SENTINELS = (("LW", 255.0), ("VIS", 0.0))


def mask_counts(obs: DataFrame, product: str = "product", count: str = "cnt") -> DataFrame:
    """Counts that are not finite, outside 0-255 or the product's sentinel become missing."""
    c = F.col(count).cast("double")
    good = c.between(0.0, 255.0) & ~F.isnan(c)
    for name, value in SENTINELS:
        good = good & ~((F.col(product) == name) & (c == value))
    return obs.withColumn(count, F.when(good, c))


def axis_steps(axis: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Step from the previous point of each axis; an axis is as long as one side of a grid."""
    w = Window.partitionBy(*by).orderBy(order)
    return axis.withColumn("step", F.col(value) - F.lag(value).over(w))


def water_by_colour(r, g, b, height, sea_level: float = 1) -> Column:
    """Blue-dominant texels, or those at or under sea level."""
    r, g, b = col(r), col(g), col(b)
    blue = (b > 1.35 * r) & (b > 1.08 * g)
    return F.coalesce(blue | (col(height) <= sea_level), blue, F.lit(False))


def water_by_elevation(r, g, b, elevation) -> Column:
    """Dark fill is water; else land below -5 m that is neither bright sand nor bright ice."""
    r, g, b, e = col(r), col(g), col(b), col(elevation)
    dark = (F.greatest(r, g, b) <= 24) & (b >= r)
    sand = (r > 120) & (r > b + 30)
    ice = (r > 150) & (g > 150) & (b > 150)
    return F.when(dark, F.lit(True)).when(e.isNull(), F.lit(False)).otherwise((e < -5) & ~sand & ~ice)
