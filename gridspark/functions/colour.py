"""Transfer functions and luminance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip, col

# Luminance weights of linear red, green and blue.
LUMA = (0.2126, 0.7152, 0.0722)


def srgb_to_linear(byte: Column | str) -> Column:
    """A 0-255 sRGB code as linear light in 0-1."""
    s = col(byte) / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(light: Column | str) -> Column:
    """Linear light in 0-1 as an sRGB fraction in 0-1."""
    x = clip(light, 0.0, 1.0)
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def luminance(r: Column | str, g: Column | str, b: Column | str) -> Column:
    return LUMA[0] * col(r) + LUMA[1] * col(g) + LUMA[2] * col(b)
