"""Sun and Moon light, eclipses, gates, frames."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip, col, smoothstep

# Astronomical unit (km), solar irradiance at it (W/m2), Moon's mean distance in Earth radii, light of
# the full Moon at that distance relative to the Sun's, and the terms (factor, power) of its dimming in magnitudes with the
# phase angle in degrees.
AU_KM, SOLAR_CONSTANT, MOON_DISTANCE, FULL_MOON = 149_597_870.7, 1361.0, 60.27, 2.5e-6
PHASE_TERMS = ((0.026, 1), (4.0e-9, 4))


def night_gate(cosine: Column | str) -> Column:
    """0 with the Sun 5 degrees under the nadir horizon, 1 from 20 degrees."""
    return smoothstep(-0.0872, -0.0872 - 0.2548, cosine)


def irradiance(distance_km: Column | str) -> Column:
    return SOLAR_CONSTANT * F.pow(AU_KM / col(distance_km), F.lit(2.0))


def moonlight(phase_degrees: Column | str, distance_radii: Column | str) -> Column:
    """Moonlight relative to sunlight, from the phase angle and the distance, by magnitudes against the mean full Moon.

    Both the phase and a greater distance add magnitudes; a hundred times less light is five of them.
    """
    phase = [factor * F.pow(col(phase_degrees), F.lit(float(power))) for factor, power in PHASE_TERMS]
    away = 5.0 * F.log10(F.greatest(col(distance_radii), F.lit(1.0)) / MOON_DISTANCE)
    return FULL_MOON * F.pow(F.lit(100.0), -(phase[0] + phase[1] + away) / 5.0)


def angular_radius(radius_km: Column | str, distance_km: Column | str) -> Column:
    """Apparent radius in radians; NULL when the body would enclose the observer."""
    ratio = col(radius_km) / col(distance_km)
    return F.when(ratio.between(0.0, 1.0), F.asin(ratio))


def earth_fixed(vector: Column, sidereal: Column | str) -> Column:
    """Rotate an equator-of-date vector by the sidereal angle (radians)."""
    th = col(sidereal)
    return F.array(F.cos(th) * vector[0] + F.sin(th) * vector[1],
                   F.cos(th) * vector[1] - F.sin(th) * vector[0], vector[2])


def _cap(radius: Column, offset: Column) -> Column:
    """Area that a chord at a signed distance from the centre cuts off a disc, on its far side."""
    depth = clip(offset / radius, -1.0, 1.0)
    return radius * radius * (F.acos(depth) - depth * F.sqrt(1.0 - depth * depth))


def visible_fraction(a: Column | str, b: Column | str, d: Column | str) -> Column:
    """Share of a disc of radius ``a`` left uncovered by one of radius ``b`` at separation ``d``.

    Two discs that cross have a common chord; what they share is the cap of each beyond it.
    """
    front, back, apart = col(b), col(a), col(d)
    inner, outer = F.least(front, back), F.greatest(front, back)
    chord = (apart + (back - front) * (back + front) / F.nullif(apart, F.lit(0.0))) / 2.0
    shared = F.when(apart >= inner + outer, F.lit(0.0)).when(apart + inner <= outer, math.pi * inner * inner) \
        .otherwise(_cap(back, chord) + _cap(front, apart - chord))
    return clip(1.0 - shared / (math.pi * back * back), 0.0, 1.0)
