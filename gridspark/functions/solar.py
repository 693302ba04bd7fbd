"""Low-precision Sun: declination, equation of time, zenith cosine (about 0.1 degree)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import col
from .timefn import day_hours, day_of_year

# Fourier coefficients of the declination (radians), constant then cos, sin per order.
DECLINATION = (0.006918, ((-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148)))
# The same for the equation of time, to be scaled to minutes.
EQUATION = (0.000075, ((0.001868, -0.032077), (-0.014615, -0.040849)))
EQUATION_MINUTES = 229.18


def year_angle(t_us: Column | str) -> Column:
    return 2 * math.pi / 365 * (day_of_year(t_us) - 1 + (day_hours(t_us) - 12.0) / 24.0)


def _series(angle: Column, constant: float, terms) -> Column:
    total = F.lit(constant)
    for order, (c, s) in enumerate(terms, start=1):
        total = total + c * F.cos(order * angle) + s * F.sin(order * angle)
    return total


def declination(t_us: Column | str, orders: int = 3) -> Column:
    """Declination in radians; two orders give the coarser form used by the storm oval."""
    return _series(year_angle(t_us), DECLINATION[0], DECLINATION[1][:orders])


def equation_of_time(t_us: Column | str) -> Column:
    """Minutes."""
    return EQUATION_MINUTES * _series(year_angle(t_us), *EQUATION)


def with_time_terms(times: DataFrame, t_us: str | Column) -> DataFrame:
    """Add ``sun_dec`` (radians) and ``sun_minutes`` to a time dimension; a grid then joins them by time."""
    return times.withColumns({
        "sun_dec": declination(t_us), "sun_minutes": day_hours(t_us) * 60.0 + equation_of_time(t_us)})


def zenith_cosine_of(dec: Column | str, minutes: Column | str, lat: Column | str, lon: Column | str) -> Column:
    """Cosine of the zenith angle from the terms of ``with_time_terms``."""
    dec, phi = col(dec), F.radians(col(lat))
    hour_angle = F.radians((col(minutes) + 4.0 * col(lon)) / 4.0 - 180.0)
    return F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(hour_angle)


def zenith_cosine(t_us, lat, lon) -> Column:
    """Cosine of the Sun's zenith angle at a place and time."""
    return zenith_cosine_of(declination(t_us), day_hours(t_us) * 60.0 + equation_of_time(t_us), lat, lon)


def subsolar_lon(t_us: Column | str) -> Column:
    """Degrees east of the point under the Sun."""
    return -15.0 * (day_hours(t_us) - 12.0 + equation_of_time(t_us) / 60.0)


def sun_vector(t_us: Column | str, orders: int = 3) -> Column:
    """Earth-fixed unit vector to the Sun."""
    dec, lon = declination(t_us, orders), F.radians(subsolar_lon(t_us))
    return F.array(F.cos(dec) * F.cos(lon), F.cos(dec) * F.sin(lon), F.sin(dec))


def albedo(count: Column | str, cosine: Column | str) -> Column:
    """Reflectance from a visible count; missing where the Sun is below the 0.1 cosine."""
    count, cosine = col(count), col(cosine)
    return F.when(cosine >= 0.1, F.pow(count / 255.0, F.lit(2.0)) / F.greatest(cosine, F.lit(0.12)))
