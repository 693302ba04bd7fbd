"""Deep convection, storm steering, flash rates and detection scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import row_lat
from ..functions.numeric import clip, rint255, smoothstep
from ..functions.physics import flash_rate
from ..operators.kernels import max_filter
from ..operators.quantiles import histogram_percentile
from ..operators.regrid import block_mean, regrid_area

GRID = "grid_id"


def storm_threshold(sky: DataFrame, height: int, band_limit: float = 50.0, floor: float = 175.0) -> DataFrame:
    """(grid, threshold): 99th percentile of the tropical infrared counts, never under ``floor``.

    Counts are whole numbers, so the percentile comes from a histogram.
    """
    tropics = sky.where(F.abs(row_lat("y", height)) < band_limit)
    return histogram_percentile(tropics, [GRID], "ir", 0.99, "threshold").withColumn(
        "threshold", F.greatest(F.col("threshold"), F.lit(floor)))


def deep_convection(sky: DataFrame, height: int, width: int, out: tuple[int, int]) -> DataFrame:
    """Observed storm tops, 0-1, on the ``out`` grid: cold against the day's own tail and the clear sky.

    ``sky`` carries ir and ir_cold. A grid without valid tropical counts gives 0.
    """
    tops = sky.join(storm_threshold(sky, height), GRID, "left")
    tropical = F.abs(row_lat("y", height)) < 50.0
    cold = F.coalesce(smoothstep(F.col("threshold") - 8.0, F.col("threshold") + 4.0, "ir"), F.lit(0.0))
    departed = F.coalesce(smoothstep(30.0, 60.0, F.col("ir") - F.col("ir_cold")), F.lit(0.0))
    conv = rint255(F.when(tropical, cold * departed).otherwise(0.0)).cast("double")
    cells = tops.select(GRID, "y", "x", conv.alias("conv"))
    boxed = regrid_area(cells, ["conv"], (height, width), out)
    return boxed.withColumn("conv", F.floor(F.round("conv", 6) + 0.5) / 255.0)


def steer_storms(packed: DataFrame, convection: DataFrame, height: int, width: int) -> DataFrame:
    """Byte bands cloud, cape, rain with storms put where cold tops are seen.

    Unstable air within 4 cells lets a top become a storm; rain without a top within 8 cells keeps a
    quarter. A missing convection field changes nothing. Input bands are the raw model, so repeated runs
    from it agree.
    """
    key = [GRID, "y", "x"]
    both = packed.join(convection.select(*key, "conv"), key, "left").withColumn("_top", F.rint(F.col("conv") * 255.0))
    both = max_filter(both, {"_cape": ("cape", 9), "_near": ("_top", 17)}, height, width)
    storm = clip(F.col("conv") * smoothstep(5.0, 25.0, "_cape"), 0.0, 1.0)
    dry = 0.25 + 0.75 * smoothstep(0.05, 0.3, F.col("_near") / 255.0)

    def out(name, base, level):
        value = F.rint(F.greatest(base, storm * level * 255.0)).cast("int")
        return F.when(F.col("conv").isNull(), F.col(name)).otherwise(value).alias(name)

    return both.select(*key, out("cloud", F.col("cloud").cast("double"), 0.85),
                       out("cape", F.col("cape").cast("double"), 0.40), out("rain", F.col("rain") * dry, 0.55))


def flash_rates(bands: DataFrame, height: int, width: int, n: int, rows_per_band: int,
                names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """Expected flashes per second by grid and latitude band, with totals by rollup."""
    blocks = block_mean(bands, list(names), n, height, width)
    lat = row_lat("y", height // n)
    cape, rain, cloud = (F.col(c) / 255.0 for c in names)
    rates = blocks.select(GRID, F.floor(F.col("y") / rows_per_band).cast("int").alias("band"),
                          flash_rate(cape, rain, cloud, lat).alias("rate"))
    return rates.rollup(GRID, "band").agg(F.sum("rate").alias("rate"), F.count(F.lit(1)).alias("cells"))


def storm_scores(storms: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """Observed tops, the share of them with a model storm near, and the share of flash rate on clear sky."""
    both = max_filter(storms, {"_near": ("storm", size)}, height, width)
    return both.groupBy(GRID).agg(
        F.count_if(F.col("top")).alias("tops"), F.avg(F.when(F.col("top"), F.col("_near").cast("double"))).alias("matched"),
        (F.sum(F.when(F.col("clear"), F.col("rate")).otherwise(0)) / F.sum("rate")).alias("clear_share"))


def strongest_storm(bands: DataFrame, height: int) -> DataFrame:
    """Per grid the cell of the largest cape x cloud x rain outside the polar quarters; first on ties."""
    inside = bands.where((F.col("y") >= height // 4) & (F.col("y") < height * 3 // 4))
    score = (F.col("cape") * F.col("cloud") * F.col("rain")).alias("score")
    best = inside.select(GRID, "y", "x", score).groupBy(GRID).agg(
        F.max("score").alias("score"), F.max_by(F.struct("y", "x"), F.struct("score", -F.col("y"), -F.col("x"))).alias("p"))
    return best.select(GRID, "p.y", "p.x", "score")
