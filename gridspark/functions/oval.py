"""Synthetic auroral storm oval from a Kp index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import clip, col, rint255
from .solar import sun_vector

# Geographic position of the dipole pole, degrees.
POLE = (80.8, -72.6)


def _pole() -> tuple[float, float, float]:
    la, lo = math.radians(POLE[0]), math.radians(POLE[1])
    return math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def with_time_terms(times: DataFrame, t_us: str) -> DataFrame:
    """Add ``noon`` and ``east``, the axes of the magnetic frame, to a time dimension.

    They depend on time only, so they are made once per time and not once per cell.
    """
    pole = [F.lit(p) for p in _pole()]
    df = times.withColumn("_sun", sun_vector(t_us, orders=2))
    df = df.withColumn("_along", _dot(F.col("_sun"), pole))
    df = df.withColumn("_raw", F.array(*[F.col("_sun")[i] - F.col("_along") * pole[i] for i in range(3)]))
    df = df.withColumn("_size", F.sqrt(_dot(F.col("_raw"), F.col("_raw"))))
    df = df.withColumn("noon", F.transform("_raw", lambda c: c / F.col("_size")))
    n = F.col("noon")
    east = F.array(pole[1] * n[2] - pole[2] * n[1], pole[2] * n[0] - pole[0] * n[2], pole[0] * n[1] - pole[1] * n[0])
    return df.withColumn("east", east).drop("_sun", "_along", "_raw", "_size")


def probability(lat, lon, noon: Column | str, east: Column | str, kp: Column | float) -> Column:
    """Probability 0-1 of aurora at a place for the frame of ``with_time_terms``."""
    noon, east = col(noon), col(east)
    kp = kp if isinstance(kp, Column) else F.lit(float(kp))
    la, lo = F.radians(col(lat)), F.radians(col(lon))
    point = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
    pole = [F.lit(p) for p in _pole()]
    magnetic = F.abs(F.degrees(F.asin(clip(_dot(point, pole), -1.0, 1.0))))
    # 1 at magnetic midnight, -1 at noon: minus the cosine of the angle from noon.
    e, n = _dot(point, east), _dot(point, noon)
    night = -n / F.sqrt(e * e + n * n)
    inner = 66.0 - 1.8 * kp - 4.0 * night
    outer = 73.0 - 0.8 * kp - 3.5 * night
    depth = (magnetic - inner) / F.greatest(outer - inner, F.lit(1.0))
    peak = F.least(F.lit(0.9), 0.15 + 0.1 * kp)
    z = (depth - 0.45) / 0.32
    return clip(peak * (0.55 + 0.45 * night) * F.exp(-(z * z)), 0.0, 1.0)


def probability_byte(lat, lon, noon, east, kp) -> Column:
    return rint255(probability(lat, lon, noon, east, kp))
