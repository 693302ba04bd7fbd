"""Pixel geometry, map projection and directions on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip, col, lit


def row_lat(y: Column | str, height: int) -> Column:
    """Latitude in degrees of the centre of row ``y``; row 0 is the northernmost."""
    return 90.0 - (col(y) + 0.5) * (180.0 / height)


def col_lon(x: Column | str, width: int) -> Column:
    """Longitude in degrees of the centre of column ``x``; column 0 starts at -180."""
    return -180.0 + (col(x) + 0.5) * (360.0 / width)


def lat_row(lat: Column | str, height: int) -> Column:
    """The row that holds a latitude, clamped to the grid."""
    y = F.floor((90.0 - col(lat)) * (height / 180.0))
    return F.greatest(F.lit(0), F.least(F.lit(height - 1), y)).cast("int")


def lon_col(lon: Column | str, width: int) -> Column:
    """The column that holds a longitude, wrapped round the grid."""
    return F.pmod(F.floor((col(lon) + 180.0) * (width / 360.0)), F.lit(width)).cast("int")


def unwrap_lon(lon: Column | str, limit: float = 179.95) -> Column:
    """Longitudes past the limit are taken as west of the antimeridian."""
    lon = col(lon)
    return F.when(lon > limit, lon - 360.0).otherwise(lon)


def lat_band(lat: Column | str, lo: float, hi: float, absolute: bool = True) -> Column:
    """True inside the closed latitude band."""
    v = F.abs(col(lat)) if absolute else col(lat)
    return v.between(lo, hi)


def parse_proj(text: Column | str) -> Column:
    """A ``+key=value`` projection string as MAP<STRING,DOUBLE> of its numeric keys."""
    text = col(text)
    pattern = F.lit(r"\+(\w+)=([-\d.]+)")
    keys = F.regexp_extract_all(text, pattern, F.lit(1))
    values = F.regexp_extract_all(text, pattern, F.lit(2))
    return F.map_from_arrays(keys, F.transform(values, lambda v: v.cast("double")))


def polar_stereographic(lat, lon, *, a_km, b_km, lat_ts, lon_0, north) -> tuple[Column, Column]:
    """Ellipsoidal polar stereographic easting and northing in km.

    ``north`` is a boolean column or value; the southern aspect is the northern one mirrored.
    """
    lat, lon, a, b = col(lat), col(lon), lit(a_km), lit(b_km)
    sign = F.when(lit(north), F.lit(1.0)).otherwise(F.lit(-1.0))
    ecc = F.sqrt(1.0 - (b / a) * (b / a))

    def conformal(phi: Column) -> Column:
        es = ecc * F.sin(phi)
        return F.tan(math.pi / 4 - phi / 2.0) / F.pow((1.0 - es) / (1.0 + es), ecc / 2.0)

    phi = F.radians(lat) * sign
    lam = F.radians(lon - lit(lon_0)) * sign
    true = F.radians(F.abs(lit(lat_ts)))
    scale = F.cos(true) / F.sqrt(1.0 - ecc * ecc * F.sin(true) * F.sin(true))
    rho = a * scale * conformal(phi) / conformal(true)
    return sign * rho * F.sin(lam), -sign * rho * F.cos(lam)


def unit_vector(lat: Column | str, lon: Column | str) -> Column:
    """Earth-fixed unit vector of a latitude and longitude in degrees."""
    la, lo = F.radians(col(lat)), F.radians(col(lon))
    return F.array(F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))


def scene_vector(lat: Column | str, lon: Column | str) -> Column:
    """The unit vector in the mirrored frame, whose second axis points west."""
    la, lo = F.radians(col(lat)), F.radians(col(lon))
    return F.array(F.cos(la) * F.cos(lo), -F.cos(la) * F.sin(lo), F.sin(la))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def geocentric_lat(lat: Column | str, alt_km: Column | str) -> Column:
    """Geocentric latitude (degrees) of a geodetic one at an altitude, on the WGS72 ellipsoid."""
    flat = 1.0 / 298.26
    e2 = flat * (2.0 - flat)
    phi, alt = F.radians(col(lat)), col(alt_km)
    n = 6378.135 / F.sqrt(1.0 - e2 * F.sin(phi) * F.sin(phi))
    return F.degrees(F.atan2((n * (1.0 - e2) + alt) * F.sin(phi), (n + alt) * F.cos(phi)))


def horizon_dip(alt_km: Column | str, radius_km: float = 6371.0) -> Column:
    """Angle in degrees from the local horizontal down to the limb."""
    return F.degrees(F.acos(radius_km / (radius_km + col(alt_km))))


def destination(lat: Column, lon: Column, bearing: Column, arc: Column) -> tuple[Column, Column, Column]:
    """Great-circle end point and the bearing back from it; all angles in radians."""
    sin_end = F.sin(lat) * F.cos(arc) + F.cos(lat) * F.sin(arc) * F.cos(bearing)
    lat2 = F.asin(clip(sin_end, -1.0, 1.0))
    lon2 = lon + F.atan2(F.sin(bearing) * F.sin(arc) * F.cos(lat), F.cos(arc) - F.sin(lat) * F.sin(lat2))
    return lat2, lon2, bearing_to(lat2, lon2, lat, lon)


def bearing_to(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Initial great-circle bearing in radians from one point to another."""
    d = to_lon - lon
    return F.atan2(F.sin(d) * F.cos(to_lat),
                   F.cos(lat) * F.sin(to_lat) - F.sin(lat) * F.cos(to_lat) * F.cos(d))


def wrapped_distance(a: Column | str, b: Column | str, period: float = 1.0) -> Column:
    """Shortest distance on a circle of the given period, for positions within one turn."""
    d = F.abs(col(a) - col(b))
    return F.least(d, F.lit(period) - d)
