"""Clipping, smoothsteps and the three rounding conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def missing_if_nan(c: Column | str) -> Column:
    """NaN becomes NULL; the library never carries NaN."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def clip(c: Column | str, lo, hi) -> Column:
    """``c`` limited to [lo, hi]; NULL stays NULL (``least``/``greatest`` alone would drop it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(lit(lo), F.least(lit(hi), c)))


def smoothstep(e0, e1, c: Column | str) -> Column:
    """Cubic step from 0 at ``e0`` to 1 at ``e1``; ``e0 > e1`` gives a falling step. NULL stays NULL."""
    e0, e1 = lit(e0), lit(e1)
    t = clip((col(c) - e0) / (e1 - e0), 0.0, 1.0)
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def rint255(c: Column | str) -> Column:
    """A 0-1 field as a byte, half to even. NULL stays NULL."""
    return F.rint(clip(c, 0.0, 1.0) * 255.0).cast("int")


def half_up_255(c: Column | str) -> Column:
    """A 0-1 field as a byte, adding a half and cutting."""
    return F.floor(clip(c, 0.0, 1.0) * 255.0 + 0.5).cast("int")


def half_away(c: Column | str) -> Column:
    """Nearest integer, halves away from zero."""
    c = col(c)
    return (F.signum(c) * F.floor(F.abs(c) + 0.5)).cast("bigint")


def r6(c: Column | str) -> Column:
    """Rounded to six places, with negative zero removed, for comparable outputs."""
    return F.round(col(c), 6) + F.lit(0.0)


def floor_div(c: Column | str, n: int) -> Column:
    """Integer floor division that also holds for negative numbers."""
    return F.floor(col(c) / F.lit(float(n))).cast("int")


def sum_ints(*cols: Column) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total
