"""Fusion of observed and model fields on one grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.physics import angstrom_fraction, depth_fraction

KEY = ["grid_id", "y", "x"]


def fuse_sources(observed: DataFrame, aerosol: DataFrame, ice: DataFrame) -> DataFrame:
    """Left joins on the cell; each optional source has its own fallback.

    Green is the ice concentration, else the cloud-top coldness. Blue and alpha carry the aerosol, else
    the observed fraction and 1. All sides share the key, so one shuffle each serves the chain.
    """
    tau = F.greatest(F.lit(0.0), F.col("tau"))
    out = observed.join(aerosol, KEY, "left").join(ice, KEY, "left")
    has = F.col("tau").isNotNull()
    return out.select(
        *KEY, "cover", F.coalesce("ice", "coldness").alias("green"),
        F.when(has, angstrom_fraction("angstrom")).otherwise(F.when(F.col("missing"), 0.0).otherwise(1.0)).alias("blue"),
        F.when(has, depth_fraction(tau)).otherwise(F.lit(1.0)).alias("alpha"))
