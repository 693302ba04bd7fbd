"""Quantised model fields and optical depths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip, col, smoothstep


def cloud_fraction(percent: Column | str, water: Column | str) -> Column:
    """Cloud cover weakened where the column holds little water."""
    wet = 1.0 - F.exp(-75.0 * F.greatest(col(water), F.lit(0.0)))
    return clip(col(percent) / 100.0, 0.0, 1.0) * wet


def cape_fraction(cape: Column | str) -> Column:
    return clip(col(cape) / 4000.0, 0.0, 1.0)


def rain_fraction(rate: Column | str) -> Column:
    """kg/m2/s on a log scale that reaches 1 at 50 mm/h."""
    return clip(F.log1p(3600.0 * F.greatest(col(rate), F.lit(0.0))) / math.log(51.0), 0.0, 1.0)


def rain_rate(fraction: Column | str) -> Column:
    """Inverse of ``rain_fraction`` inside its range."""
    return F.expm1(col(fraction) * math.log(51.0)) / 3600.0


def optical_depth(tau: Column | str) -> Column:
    return clip(tau, 0.0, 4.0)


def angstrom(tau440: Column | str, tau645: Column | str) -> Column:
    floor = F.lit(1e-4)
    ratio = F.greatest(col(tau440), floor) / F.greatest(col(tau645), floor)
    return clip(-F.ln(ratio) / math.log(440 / 645), -0.5, 2.5)


def angstrom_fraction(alpha: Column | str) -> Column:
    return (col(alpha) + 0.5) / 3.0


def depth_fraction(tau: Column | str) -> Column:
    return F.sqrt(col(tau) / 4.0)


def flash_rate(cape, rain, cloud, lat) -> Column:
    """Expected flashes per second of a one-degree cell; the inputs are 0-1 fractions."""
    return (0.17 * smoothstep(0.025, 0.4, cape) * smoothstep(0.05, 0.5, rain)
            * smoothstep(0.3, 0.8, cloud) * F.cos(F.radians(col(lat))))
