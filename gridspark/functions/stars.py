"""Star codes, positions of date, brightness and colour."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import dot, norm
from .numeric import clip, col, half_away

# Code ranges. Magnitudes -2..8 use 1-255, colours -0.5..2.5 use 0-255,
# proper motion steps are 0.25 mas per year around 32768.
MAG, COLOUR, MOTION_STEP = (-2.0, 8.0), (-0.5, 2.5), 0.25
RA_CODES, DEC_CODES = 16_777_216, 16_777_215
MAS_RADIANS = math.pi / 180 / 3_600_000

# Red, green, blue of a star at these B-V values.
COLOUR_STOPS = (
    (-0.35, (0.62, 0.71, 1.00)),
    (0.0, (0.79, 0.85, 1.00)),
    (0.4, (0.97, 0.96, 1.00)),
    (0.8, (1.00, 0.92, 0.80)),
    (1.4, (1.00, 0.78, 0.55)),
    (2.0, (1.00, 0.66, 0.40)),
)
# Sea-level optical depths of red, green and blue.
AIR_DEPTHS = (0.050, 0.097, 0.216)


def _scaled(c, bounds, levels) -> Column:
    return half_away(clip((col(c) - bounds[0]) / (bounds[1] - bounds[0]), 0.0, 1.0) * levels)


def encode(ra="ra", dec="dec_deg", vmag="vmag", bv="bv", pm_ra="pm_ra", pm_dec="pm_dec") -> dict[str, Column]:
    """The integer codes of one star."""
    turn = F.pmod(col(ra), F.lit(360.0)) / 360.0

    def motion(c):
        return clip(half_away(col(c) / MOTION_STEP) + 32768, 0, 65535).cast("int")

    return {
        "ra_code": F.least(half_away(turn * RA_CODES), F.lit(RA_CODES - 1)).cast("int"),
        "dec_code": _scaled(dec, (-90.0, 90.0), DEC_CODES).cast("int"),
        "mag_code": (_scaled(vmag, MAG, 254) + 1).cast("int"),
        "bv_code": _scaled(bv, COLOUR, 255).cast("int"),
        "pm_ra_code": motion(pm_ra),
        "pm_dec_code": motion(pm_dec),
    }


def decode() -> dict[str, Column]:
    """The star of a row of codes named as in ``encode``."""
    return {
        "ra": F.col("ra_code") / float(RA_CODES) * 360.0,
        "dec_deg": F.col("dec_code") / float(DEC_CODES) * 180.0 - 90.0,
        "vmag": MAG[0] + (F.col("mag_code") - 1) / 254.0 * (MAG[1] - MAG[0]),
        "bv": COLOUR[0] + F.col("bv_code") / 255.0 * (COLOUR[1] - COLOUR[0]),
        "pm_ra": (F.col("pm_ra_code") - 32768) * MOTION_STEP,
        "pm_dec": (F.col("pm_dec_code") - 32768) * MOTION_STEP,
    }


def pack_words() -> dict[str, Column]:
    """The codes as three 32-bit words, most significant byte first."""
    def c(name):
        return F.col(name).cast("bigint")

    def left(x, n):
        return F.shiftleft(x, n)

    return {
        "word0": left(c("ra_code"), 8).bitwiseOR(F.shiftright(c("dec_code"), 16)),
        "word1": left(c("dec_code").bitwiseAND(F.lit(65535)), 16)
            .bitwiseOR(left(c("mag_code"), 8)).bitwiseOR(c("bv_code")),
        "word2": left(c("pm_ra_code"), 16).bitwiseOR(c("pm_dec_code")),
    }


def unpack_words() -> dict[str, Column]:
    w0, w1, w2 = (F.col(f"word{i}") for i in range(3))
    return {
        "ra_code": F.shiftright(w0, 8).cast("int"),
        "dec_code": F.shiftleft(w0.bitwiseAND(F.lit(255)), 16).bitwiseOR(F.shiftright(w1, 16)).cast("int"),
        "mag_code": F.shiftright(w1, 8).bitwiseAND(F.lit(255)).cast("int"),
        "bv_code": w1.bitwiseAND(F.lit(255)).cast("int"),
        "pm_ra_code": F.shiftright(w2, 16).cast("int"),
        "pm_dec_code": w2.bitwiseAND(F.lit(65535)).cast("int"),
    }


def position_of_date(ra, dec, pm_ra, pm_dec, years, velocity: Column, matrix: Column) -> Column:
    """Unit direction after proper motion, first-order aberration and the frame's rotation."""
    r, d = F.radians(col(ra)), F.radians(col(dec))
    east_step = col(pm_ra) * MAS_RADIANS * col(years)
    north_step = col(pm_dec) * MAS_RADIANS * col(years)
    moved = (
        F.cos(d) * F.cos(r) - F.sin(r) * east_step - F.sin(d) * F.cos(r) * north_step,
        F.cos(d) * F.sin(r) + F.cos(r) * east_step - F.sin(d) * F.sin(r) * north_step,
        F.sin(d) + F.cos(d) * north_step,
    )
    seen = F.array(*[moved[i] + velocity[i] for i in range(3)])
    length = norm(seen)
    return F.transform(matrix, lambda row: dot(row, seen) / length)


def energy(vmag: Column | str, gate: Column | float = 1.0) -> Column:
    """Brightness on the fixed scale, a factor 1.8 per magnitude."""
    gate = gate if isinstance(gate, Column) else F.lit(gate)
    return gate * 0.35 * F.exp(0.587787 * (6.5 - col(vmag)))


def colour(bv: Column | str) -> list[Column]:
    """Red, green, blue at unit luminance, then drawn 15 % toward white."""
    bv = col(bv)
    bands = []
    for band in range(3):
        out = None
        for (b0, c0), (b1, c1) in zip(COLOUR_STOPS, COLOUR_STOPS[1:]):
            t = (bv - b0) / (b1 - b0)
            if b1 == COLOUR_STOPS[-1][0]:
                t = clip(t, 0.0, 1.0)
            value = c0[band] + (c1[band] - c0[band]) * t
            if b1 == COLOUR_STOPS[-1][0]:
                out = out.otherwise(value)
            else:
                out = F.when(bv < b1, value) if out is None else out.when(bv < b1, value)
        bands.append(out)
    luma = 0.2126 * bands[0] + 0.7152 * bands[1] + 0.0722 * bands[2]
    return [0.15 + 0.85 * b / luma for b in bands]


def limb_transmission(altitude_km: Column | str) -> list[Column]:
    """Share of light left, per band, on a ray grazing the air at this altitude."""
    column = 34.3 * F.exp(-col(altitude_km) / 8.5)
    return [F.exp(-depth * column) for depth in AIR_DEPTHS]
