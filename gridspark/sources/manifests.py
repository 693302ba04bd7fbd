"""Manifests and sidecars: closed JSON schemas and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a weather manifest must say.
WEATHER = ("NOAA-GFS", "model-analysis", 1440, 720)


def scan_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files as (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def closed_json(docs: DataFrame, text: str, schema: str, known: list[str], max_bytes: int | None = None) -> DataFrame:
    """Add the parsed struct ``doc``, its unknown keys, and whether it is accepted; a longest size is an option."""
    keys = F.json_object_keys(F.col(text))
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in known])))
    out = docs.withColumns({"doc": F.from_json(text, schema), "unknown_keys": unknown})
    good = F.col("unknown_keys").isNotNull() & (F.size("unknown_keys") == 0)
    if max_bytes is not None:
        good = good & (F.octet_length(text) <= max_bytes)
    return out.withColumn("accepted", F.coalesce(good, F.lit(False)))


def manifest_ok(source, kind, width, height, valid_unix, sha256, payload_bytes) -> Column:
    """True for a supported weather manifest whose payload has the right size."""
    return F.coalesce(
        (source == WEATHER[0]) & (kind == WEATHER[1]) & (width == WEATHER[2]) & (height == WEATHER[3])
        & (valid_unix > 0) & sha256.rlike("^[0-9a-fA-F]{64}$")
        & (payload_bytes == 4 * width.cast("bigint") * height), F.lit(False))


def sidecar_rule(df: DataFrame, asset: str, panorama: bool = False) -> Column:
    """First broken rule of a raw-texel sidecar row, or ``ok``; ``asset`` is the kind the caller expects."""
    stride = F.col("width").cast("bigint") * 4
    rule = (F.when(F.col("schema_version") != 1, "version")
            .when(F.col("asset") != asset, "asset")
            .when(F.col("pixel_format") != "bgra8", "pixel format")
            .when(~F.col("color_space").isin("srgb", "linear"), "colour space")
            .when(F.col("origin") != "top_left", "origin")
            .when((F.col("width") <= 0) | (F.col("height") <= 0), "extent")
            .when((F.col("color_space") == "srgb") & ~F.col("rgb_filter").eqNullSafe("linear-light-srgb-v1"), "filter")
            .when(F.col("row_stride_bytes") != stride, "stride")
            .when(F.col("payload_bytes") != stride * F.col("height"), "payload size"))
    if panorama:
        rule = (rule.when(F.col("width") != 2 * F.col("height"), "not 2:1")
                .when((F.col("left_lon") != -180) | (F.col("top_lat") != 90), "orientation"))
    return rule.otherwise("ok")
