"""Observed cloud cover fused with the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import row_lat
from ..functions.numeric import clip, rint255, smoothstep
from ..operators.kernels import gaussian
from ..operators.regrid import block_mean, resize
from ..operators.seams import balance

KEY = ["grid_id", "y", "x"]
# Feather of the model fill in pixels, and the latitudes between which the mosaic fades out.
FEATHER, EDGE = 28.0, (72.7, 70.5)


def byte_round(c: Column) -> Column:
    """A resampled byte: nearest, halves up, free of the noise of the weighted sum. NULL stays NULL."""
    return F.floor(F.round(clip(c, 0.0, 255.0), 6) + 0.5)


def upsample(fields: DataFrame, bands: list[str], source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """0-1 fields quantised to bytes, enlarged bicubically together, as 0-1."""
    coded = fields.select(*KEY, *[rint255(b).cast("double").alias(b) for b in bands])
    big = resize(coded, bands, source, target, "bicubic")
    return big.select(*KEY, *[(byte_round(F.col(b)) / 255.0).alias(b) for b in bands])


def cloud_cover(sky: DataFrame, model: DataFrame, height: int, width: int) -> DataFrame:
    """Cover, cloud-top coldness and the missing flag per cell.

    ``sky`` carries albedo, vis_clear, ir, ir_day, ir_night and cosine; ``model`` carries the enlarged
    model fields model and low. Every missing value has its own meaning, as each formula below says. The model may lack
    cells or values: without low cloud its total cloud stands for it, and without both the observation stands alone, so
    a cell is empty only where it was neither observed nor modelled.
    """
    lat = F.abs(row_lat("y", height))
    df = sky.withColumn("excess", F.col("albedo") - F.coalesce(F.least(F.col("vis_clear"), F.lit(0.45)), F.lit(0.12)))
    df = balance(df, "excess", height, width)
    guess = 65.0 + 60.0 * F.pow(lat / 72.0, F.lit(2.0))
    df = df.select("*", smoothstep(0.02, 0.45, "excess").alias("vis"), smoothstep(0.10, 0.34, "cosine").alias("day"),
                   F.coalesce("ir_night", "ir_day", guess).alias("cold"), F.col("ir").isNull().alias("missing"))
    warm = F.coalesce("ir_day", "cold")
    bright = F.col("day") * F.coalesce(smoothstep(0.0, 0.02, "excess"), F.lit(0.0))
    df = df.withColumn("infra", F.coalesce(F.greatest(
        smoothstep(16.0, 60.0, F.col("ir") - F.col("cold")), bright * smoothstep(16.0, 60.0, F.col("ir") - warm)), F.lit(0.0)))
    # Blurred on its own and joined back: the windows then move one value per cell, not the whole row.
    holes = sky.select(*KEY, F.when(F.col("ir").isNull(), 255.0).otherwise(0.0).alias("feather"))
    holes = gaussian(holes, "feather", FEATHER, height, width)
    holes = holes.withColumn("feather", byte_round(F.col("feather")) / 255.0)
    df = df.join(holes, KEY).join(model.select(*KEY, F.col("model").alias("_model"), F.col("low").alias("_low")), KEY, "left")
    df = df.withColumn("_low", F.coalesce("_low", "_model"))
    by_day = F.when(F.col("vis").isNotNull(), F.greatest(F.col("vis"), 0.85 * F.col("infra"))).otherwise(F.col("infra"))
    by_night = F.greatest(F.col("infra"), 0.8 * F.col("_low"))
    seen = F.col("day") * by_day + (1.0 - F.col("day")) * by_night
    fill = F.greatest(F.when(F.col("missing"), 1.0).otherwise(0.0), clip(2.0 * F.col("feather"), 0.0, 1.0))
    df = df.withColumn("cover", fill * F.col("_model") + (1.0 - fill) * seen)
    edge = smoothstep(EDGE[0], EDGE[1], lat)
    alone = F.when(F.col("_model").isNull() & ~F.col("missing"), seen)
    return df.select(*KEY, F.coalesce(edge * F.col("cover") + (1.0 - edge) * F.col("_model"), alone).alias("cover"),
                     F.when(F.col("missing"), 0.3 * F.col("_model")).otherwise(smoothstep(90.0, 215.0, "ir")).alias("coldness"),
                     "missing", F.col("cold").alias("ir_cold"), "ir")
