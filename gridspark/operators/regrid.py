"""Regridding: one weight table per axis, joined by equality, rows first and then columns.

A weight table is (target, source, w). It has as many rows as one axis has taps, so its size depends
on the grid extent only, never on the data; it is broadcast under the checked limit.
"""

from __future__ import annotations

from collections import Counter

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..session import literal_table
from .asof import asof_join
from .ordered import neighbour

GRID = "grid_id"
AXIS = "target int, source int, w double"
Weights = list[tuple[int, int, float]]


def overlap_weights(source: int, target: int) -> Weights:
    """Share of each target pixel covered by each source pixel."""
    ratio = source / target
    out = []
    for t in range(target):
        lo, hi = t * ratio, (t + 1) * ratio
        for s in range(int(math.floor(lo)), min(source, int(math.ceil(hi)))):
            part = min(hi, s + 1.0) - max(lo, float(s))
            if part > 0:
                out.append((t, s, part / ratio))
    return out


def _sinc(x: float) -> float:
    return 1.0 if x == 0.0 else math.sin(math.pi * x) / (math.pi * x)


def _cubic(x: float, a: float = -0.5) -> float:
    if x < 1.0:
        return ((a + 2.0) * x - (a + 3.0)) * x * x + 1.0
    return (((x - 5.0) * x + 8.0) * x - 4.0) * a if x < 2.0 else 0.0


def _spline(x: float) -> float:
    if x < 1.0:
        return (4.0 - 6.0 * x * x + 3.0 * x ** 3) / 6.0
    return (2.0 - x) ** 3 / 6.0 if x < 2.0 else 0.0


KERNELS = {
    "box": (0.5, lambda x: 1.0 if x <= 0.5 else 0.0),
    "bilinear": (1.0, lambda x: max(0.0, 1.0 - x)),
    "bicubic": (2.0, _cubic),
    "lanczos": (3.0, lambda x: _sinc(x) * _sinc(x / 3.0) if x < 3.0 else 0.0),
    "bspline": (2.0, _spline),
}


def kernel_weights(source: int, target: int, kernel: str) -> Weights:
    """Taps of a resampling kernel, widened by the scale when shrinking and normalised per target."""
    support, weight = KERNELS[kernel]
    scale = source / target
    stretch = max(scale, 1.0)
    out = []
    for t in range(target):
        centre = (t + 0.5) * scale
        lo = max(0, int(centre - support * stretch + 0.5))
        hi = min(source, int(centre + support * stretch + 0.5))
        taps = [(s, weight(abs((s + 0.5 - centre) / stretch))) for s in range(lo, hi)]
        total = sum(w for _, w in taps)
        out += [(t, s, w / total) for s, w in taps if w != 0.0]
    return out


def bspline_weights(source: int, target: int) -> Weights:
    """Four cubic B-spline taps per target pixel, clamped at the ends."""
    out: dict[tuple[int, int], float] = {}
    for t in range(target):
        pos = (t + 0.5) * source / target - 0.5
        base = math.floor(pos)
        for s in range(base - 1, base + 3):
            key = (t, min(source - 1, max(0, s)))
            out[key] = out.get(key, 0.0) + _spline(abs(pos - s))
    return [(t, s, w) for (t, s), w in out.items()]


def axis_index(axis: list[float], targets: list[float], outside: str = "missing") -> list[float | None]:
    """Continuous index of each target coordinate in a strictly ascending axis."""
    if any(b <= a for a, b in zip(axis, axis[1:])):
        raise ValueError("the axis must ascend strictly")
    out: list[float | None] = []
    for t in targets:
        if t < axis[0] or t > axis[-1]:
            out.append(None if outside == "missing" else (0.0 if t < axis[0] else len(axis) - 1.0))
            continue
        lo, hi = 0, len(axis) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if axis[mid] <= t else (lo, mid)
        out.append(lo + (t - axis[lo]) / (axis[hi] - axis[lo]))
    return out


def linear_weights(index: list[float | None], source: int) -> Weights:
    """Two linear taps per target; a target without an index has none."""
    out = []
    for t, pos in enumerate(index):
        if pos is None:
            continue
        base = min(max(int(math.floor(pos)), 0), source - 2)
        out += [(t, base, 1.0 - (pos - base)), (t, base + 1, pos - base)]
    return out


def axis_index_table(axis: DataFrame, targets: DataFrame, chunk_width: float) -> DataFrame:
    """``axis_index`` as a join for axes held in tables: (axis_id, i, coord) and (axis_id, target, coord).

    The last axis point at or before each target and its successor bracket the target; targets outside
    the axis get NULL.
    """
    points = neighbour(axis, ["axis_id"], ["coord"], chunk_width, {"c1": F.col("coord")}).select(
        "axis_id", "i", F.col("coord").alias("c0"), "c1")
    hit = asof_join(targets, points, ["axis_id"], "coord", "c0", ["i", "c0", "c1"], chunk_width)
    pos = F.col("i") + (F.col("coord") - F.col("c0")) / (F.col("c1") - F.col("c0"))
    last = F.when(F.col("coord") == F.col("c0"), F.col("i").cast("double"))
    return hit.select("axis_id", "target", F.coalesce(pos, last).alias("pos"))


def separable(cells: DataFrame, rows: Weights, cols: Weights, bands: list[str], missing: str = "spread",
              normalise: bool = False) -> DataFrame:
    """Apply row weights and then column weights; two shuffles, whatever the kernel width.

    ``missing='spread'`` makes a target NULL when any tap is NULL or absent; ``'skip'`` ignores NULL taps, and
    with ``normalise`` divides by the weight that was left.
    """
    out = cells
    for axis, weights in (("y", rows), ("x", cols)):
        taps = Counter(target for target, _, _ in weights)  # an absent cell counts as NULL
        table = literal_table(cells.sparkSession, [(*w, taps[w[0]]) for w in weights], f"{AXIS}, taps int")
        joined = out.join(table, out[axis] == table["source"]).drop("source", axis)
        other = "x" if axis == "y" else "y"
        aggs = []
        for b in bands:
            total = F.sum(F.col(b) * F.col("w"))
            if missing == "spread":
                total = F.when(F.count(b) == F.max("taps"), total)
            elif normalise:
                total = total / F.sum(F.when(F.col(b).isNotNull(), F.col("w")))
            aggs.append(total.alias(b))
        out = joined.groupBy(GRID, other, F.col("target").alias(axis)).agg(*aggs)
    return out.select(GRID, "y", "x", *bands)


def resize(cells: DataFrame, bands: list[str], source: tuple[int, int], target: tuple[int, int], kernel: str,
           missing: str = "spread") -> DataFrame:
    """Kernel resize of (height, width) grids; ``missing`` is as in ``separable``."""
    return separable(cells, kernel_weights(source[0], target[0], kernel),
                     kernel_weights(source[1], target[1], kernel), bands, missing)


def regrid_area(cells: DataFrame, bands: list[str], source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Area-weighted means by fractional pixel overlap."""
    return separable(cells, overlap_weights(source[0], target[0]), overlap_weights(source[1], target[1]), bands)


def nodes_to_centres(nodes: DataFrame, band: str, width: int, node_rows: int) -> DataFrame:
    """Mean of the 2x2 nodes round each pixel centre (NULL unless all four are there), periodic in x, turned by half the width.

    Each node is sent to the four centres it touches: one shuffle, partially aggregated.
    """
    half = width // 2
    ys = F.array(F.col("y") - 1, F.col("y"))
    xs = F.array(F.pmod(F.col("x") - 1, F.lit(width)), F.col("x"))
    sent = (nodes.withColumn("_y", F.explode(ys)).where(F.col("_y").between(0, node_rows - 2))
            .withColumn("_x", F.explode(xs)))
    return (sent.groupBy(GRID, F.col("_y").alias("y"), F.pmod(F.col("_x") + half, F.lit(width)).cast("int").alias("x"))
            .agg(F.when(F.count(band) == 4, F.sum(band) / 4.0).alias(band)))


def nearest_projected(source: DataFrame, band: str, targets: DataFrame, px: Column, py: Column,
                      x0: float, dx: float, y0: float, dy: float, keys: list[str]) -> DataFrame:
    """Value of the source cell nearest to each target's projected position; 0 outside the source."""
    placed = targets.withColumns({
        "_sx": F.rint((px - x0) / dx).cast("int"), "_sy": F.rint((py - y0) / dy).cast("int")})
    src = source.select(*keys, F.col("x").alias("_sx"), F.col("y").alias("_sy"), F.col(band).alias("_b"))
    hit = placed.join(src, [*keys, "_sx", "_sy"], "left")
    return hit.withColumn(band, F.coalesce("_b", F.lit(0.0))).drop("_b", "_sx", "_sy")


def block_mean(cells: DataFrame, bands: list[str], n: int, height: int, width: int) -> DataFrame:
    """Means of whole n x n blocks; partial blocks at the edges are cut."""
    inside = cells.where((F.col("y") < height // n * n) & (F.col("x") < width // n * n))
    return inside.groupBy(GRID, F.floor(F.col("y") / n).cast("int").alias("y"),
                          F.floor(F.col("x") / n).cast("int").alias("x")).agg(*[F.avg(b).alias(b) for b in bands])
