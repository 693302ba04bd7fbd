"""Image and field statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import luminance, srgb_to_linear
from ..operators.quantiles import exact_percentiles, weighted_percentile
from ..operators.regrid import block_mean

GRID = "grid_id"


def white_point(cells: DataFrame, rgb: list[str], stride: int = 4, q: float = 0.99998) -> DataFrame:
    """Luminance percentile over every ``stride``-th row and column of each grid."""
    sub = cells.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0))
    return exact_percentiles(sub, [GRID], luminance(*[srgb_to_linear(c) for c in rgb]), {"white": q})


def mean_if(value: str, minimum: int) -> Column:
    """Mean of the valid values of a group with at least ``minimum`` of them, else missing."""
    return F.when(F.count(value) >= minimum, F.avg(value))


def block_error(a: DataFrame, b: DataFrame, band: str, n: int, height: int, width: int) -> DataFrame:
    """Mean, 99th percentile and maximum of the difference of block means of two images."""
    left = block_mean(a, [band], n, height, width).withColumnRenamed(band, "_a")
    right = block_mean(b, [band], n, height, width).withColumnRenamed(band, "_b")
    diff = left.join(right, [GRID, "y", "x"]).select(GRID, F.abs(F.col("_a") - F.col("_b")).alias("_d"))
    # An image has few blocks, so the exact percentile buffer of one image is small.
    return diff.groupBy(GRID).agg(F.avg("_d").alias("mean"), F.percentile("_d", F.lit(0.99)).alias("p99"), F.max("_d").alias("max"))


def frame_stats(cells: DataFrame, by: list[str], rgb: list[str], dark: int = 3) -> DataFrame:
    """Extremes, mean channel and share of texels brighter than ``dark``."""
    lit = F.when(F.greatest(*rgb) > dark, 1.0).otherwise(0.0)
    mean = (F.avg(rgb[0]) + F.avg(rgb[1]) + F.avg(rgb[2])) / 3.0
    return cells.groupBy(*by).agg(
        F.least(*[F.min(c) for c in rgb]).alias("lo"), F.greatest(*[F.max(c) for c in rgb]).alias("hi"),
        mean.alias("mean"), F.avg(lit).alias("lit"))


def frame_hashes(cells: DataFrame, by: list[str], bands: list[str]) -> DataFrame:
    """(by, sha256): one digest for the payload of each frame, over the digests of its rows of texels from top to bottom.

    A row of a frame is the largest unit gathered; byte bands go in the given order, texels from left to right.
    """
    texel = F.concat(*[F.lpad(F.hex(F.col(b).cast("int")), 2, "0") for b in bands])
    rows = cells.groupBy(*by, "y").agg(F.array_sort(F.collect_list(F.struct("x", texel.alias("t")))).alias("s"))
    row = F.sha2(F.unhex(F.array_join(F.transform("s", lambda v: v["t"]), "")), 256)
    held = rows.select(*by, "y", row.alias("d")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("y", "d"))).alias("s"))
    return held.select(*by, F.sha2(F.array_join(F.transform("s", lambda v: v["d"]), ""), 256).alias("sha256"))


def distinct_nodes(points: DataFrame, by: list[str], node: list[str]) -> DataFrame:
    """Points and distinct nodes per group; points are reduced to nodes before the group is."""
    nodes = points.groupBy(*by, *node).agg(F.count(F.lit(1)).alias("_n"))
    return nodes.groupBy(*by).agg(F.sum("_n").alias("points"), F.count(F.lit(1)).alias("nodes"),
                                  (F.max("_n") == 1).alias("is_unique"))


def metered_key(pixels: DataFrame, by: list[str], height: int, width: int, p: float = 0.85,
                coverage: float = 0.25) -> DataFrame:
    """The luminance at which ``p`` of the centre-weighted coverage is reached, per frame.

    Lit pixels darker than 1/500 of a reference are left out first: the lit pixel that 99 of 100 lit ones, rounded
    down, come before. Weights are whole millionths so that sums do not depend on their order.
    """
    dx = (F.col("x") + 0.5) / float(width) - 0.5
    dy = (F.col("y") + 0.5) / float(height) - 0.5
    centre = 1.0 - (F.pow(dx, F.lit(2.0)) + F.pow(dy, F.lit(2.0)))
    kept = pixels.where(F.col("coverage") >= coverage).withColumn(
        "_w", F.floor(F.col("coverage") * centre * 1e6 + 0.5).cast("bigint"))
    brightest = weighted_percentile(kept.where("lit").withColumn("_one", F.lit(1)), by, "lum", "_one",
                                    {"_ref": lambda n: F.least(F.floor(n * 99 / 100), n - 1) + 1})
    seen = kept.join(brightest, by, "left").where(
        ~F.col("lit") | F.col("_ref").isNull() | (F.col("lum") >= F.col("_ref") * 0.002))
    return weighted_percentile(seen, by, "lum", "_w", {"key": p})


def flash_counts(frames: DataFrame, by: list[str], frame: str, bands: list[str], threshold: int) -> DataFrame:
    """Per frame the pixels that rise over their darkest value by more than ``threshold`` in any band."""
    pixel = [*by, "y", "x"]
    base = frames.groupBy(*pixel).agg(*[F.min(b).alias("_m_" + b) for b in bands])
    rise = F.array_max(F.array(*[F.col(b) - F.col("_m_" + b) for b in bands]))
    return frames.join(base, pixel).groupBy(*by, frame).agg(F.count_if(rise > threshold).alias("flashes"))


def area_quantiles(cells: DataFrame, band: str, height: int, qs: dict[str, float]) -> DataFrame:
    """Quantiles of a field with each cell weighted by the cosine of its latitude."""
    lat = F.radians(90.0 - (F.col("y") + 0.5) * (180.0 / height))
    weighed = cells.withColumn("_w", F.floor(F.cos(lat) * 1e6 + 0.5).cast("bigint"))
    return weighted_percentile(weighed, [GRID], band, "_w", qs)
