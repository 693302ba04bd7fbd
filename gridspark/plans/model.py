"""Model-side fields: packing, aerosol, sea ice, retained and synthetic records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics
from ..functions.geo import col_lon, polar_stereographic, row_lat
from ..functions.numeric import clip, rint255
from ..functions.timefn import HOUR_US
from ..operators.grids import dense_grid
from ..operators.kernels import fill_holes, gaussian
from ..operators.regrid import nearest_projected
from .clouds import byte_round

KEY = ["grid_id", "y", "x"]
PACKING_VERSION, RETAIN_HOURS = 4, 6


def pack_model(fields: DataFrame, height: int, width: int) -> DataFrame:
    """Byte bands cloud, cape and rain of the raw model fields (cloud_pct, water, cape, rain).

    The quantised cloud is smoothed a little, round the globe.
    """
    bands = fields.select(*KEY, rint255(physics.cloud_fraction("cloud_pct", "water")).cast("double").alias("cloud"),
                          rint255(physics.cape_fraction("cape")).alias("cape"), rint255(physics.rain_fraction("rain")).alias("rain"))
    soft = gaussian(bands, "cloud", 0.7, height, width, wrap_x=True)
    return soft.withColumn("cloud", byte_round(F.col("cloud")).cast("int"))


def aerosol_field(depths: DataFrame) -> DataFrame:
    """Optical depth and Angstrom exponent per cell from the three wavelengths (aod440, aod550, aod645)."""
    return depths.select(*KEY, physics.optical_depth("aod550").alias("tau"), physics.angstrom("aod440", "aod645").alias("angstrom"))


def sea_ice_field(sources: DataFrame, grids: DataFrame, size: tuple[int, int], target: tuple[int, int],
                  geometry: dict, fill_steps: int = 4) -> DataFrame:
    """Ice concentration 0-1 on the target grid from polar grids of both hemispheres.

    ``sources`` is (grid_id, y, x, raw): negative is missing, 10000 is full. Missing cells take their
    neighbours a few times, then count as open water; cells outside a polar grid are 0. ``grids`` is
    (grid_id, north, target_id): which source serves which hemisphere of which target grid.
    """
    height, width = size
    conc = sources.select(*KEY, F.when(F.col("raw") >= 0, F.col("raw") / 10000.0).alias("ice"))
    filled = fill_holes(conc, "ice", fill_steps, height, width)
    cells = dense_grid(grids, *target)
    cells = cells.withColumns({"lat": row_lat("y", target[0]), "lon": col_lon("x", target[1])})
    cells = cells.where(F.when(F.col("north"), F.col("lat") > 35).otherwise(F.col("lat") < -35))
    px, py = polar_stereographic("lat", "lon", a_km=geometry["a_km"], b_km=geometry["b_km"], lat_ts=geometry["lat_ts"],
                                 lon_0=geometry["lon_0"], north=F.col("north"))
    hit = nearest_projected(filled, "ice", cells, px, py, *geometry["origin"], keys=["grid_id"])
    return hit.select(F.col("target_id").alias("grid_id"), "y", "x", clip("ice", 0.0, 1.0).alias("ice"))


def retained_observation(records: DataFrame, files: DataFrame) -> DataFrame:
    """Cloud records that stay in use: right packing, under six hours old, file and sidecar intact.

    ``records`` is (record, packing_version, clouds_us, now_us, name, sha256, bytes); ``files`` is
    (name, sha256, bytes) of what is on disk. The record keeps its own times.
    """
    found = files.select("name", F.col("sha256").alias("_sha"), F.col("bytes").alias("_bytes"))
    fresh = records.where((F.col("packing_version") == PACKING_VERSION) & F.col("clouds_us").isNotNull()
                          & (F.abs(F.col("now_us") - F.col("clouds_us")) < RETAIN_HOURS * HOUR_US))
    good = fresh.join(found, "name").where((F.col("sha256") == F.col("_sha")) & (F.col("bytes") == F.col("_bytes")))
    sidecars = files.where(F.col("name").endswith(".json")).select(F.regexp_replace("name", r"\.json$", "").alias("name"))
    return good.join(sidecars, "name", "left_semi").select(*records.columns)


def synthetic_override(current: DataFrame, oval: DataFrame, band: str, label: str) -> DataFrame:
    """The current fields with one band replaced, under a source that says it is synthetic.

    Cells for which there is no synthetic value keep their own, and no such source.
    """
    joined = current.withColumnRenamed(band, "_own").join(oval.select(*KEY, F.col("p").alias("_p")), KEY, "left")
    label = F.when(F.col("_p").isNotNull(), F.lit(f"SYNTHETIC {label} (not an observation)"))
    return joined.withColumns({band: F.coalesce("_p", "_own"), "source": label}).drop("_own", "_p")
