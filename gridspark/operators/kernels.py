"""Neighbourhood kernels over cells (grid_id, y, x, bands).

Small kernels first move every cell, once, to the block (and the borders of the next blocks) it is
needed in; every later window names the block columns first, so it runs on that one shuffle. Wide
kernels are separable and use one shuffle per axis, with a row or a column of one grid as the unit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = "grid_id"
BLOCK = ["_by", "_bx"]


def with_halo(cells: DataFrame, block: int, halo: int, height: int, width: int, wrap_x: bool = False) -> DataFrame:
    """Copy each cell to every ``block`` x ``block`` block whose ``halo``-wide border holds it.

    Adds block numbers and ``_x``, the column seen from the block (beyond the grid when wrapped).
    The result is partitioned by block.
    """
    last_y, last_x = (height - 1) // block, (width - 1) // block

    def homes(c: Column, last: int, images: Column) -> Column:
        # Every image of a cell goes to the blocks between those that its borders reach.
        def blocks(p: Column) -> Column:
            lo, hi = F.floor((p - halo) / block).cast("int"), F.floor((p + halo) / block).cast("int")
            return F.transform(F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.lit(last))),
                               lambda n: F.struct(n.alias("b"), p.alias("p")))
        return F.flatten(F.transform(images, blocks))

    x = F.col("x")
    seen = F.array(x)
    if wrap_x:  # also one turn away, where that lies in a border
        seen = F.filter(F.array(x - width, x, x + width), lambda p: p.between(-halo, width + halo - 1))
    out = cells.withColumn("_h", F.explode(homes(x, last_x, seen)))
    out = out.withColumn("_v", F.explode(homes(F.col("y"), last_y, F.array("y"))))
    out = out.select(*cells.columns, F.col("_v.b").alias("_by"), F.col("_h.b").alias("_bx"), F.col("_h.p").alias("_x"))
    return out.repartition(GRID, *BLOCK)


def core(df: DataFrame, block: int) -> DataFrame:
    """Drop the border copies again."""
    own = (F.floor(F.col("y") / block) == F.col("_by")) & (F.floor(F.col("x") / block) == F.col("_bx")) \
        & (F.col("_x") == F.col("x"))
    return df.where(own).drop(*BLOCK, "_x")


def along_x() -> Window:
    return Window.partitionBy(GRID, *BLOCK, "y").orderBy("_x")


def along_y() -> Window:
    return Window.partitionBy(GRID, *BLOCK, "_x").orderBy("y")


def beside(band: str, step: int, axis: str) -> Column:
    """Value ``step`` places on along ``_x`` or ``y``; NULL where that cell is absent, for places are coordinates, not rows."""
    window = along_x() if axis == "_x" else along_y()
    if abs(step) == 1:  # a plain neighbour row, if it stands where the cell should be
        row = F.lag if step < 0 else F.lead
        return F.when(row(axis).over(window) == F.col(axis) + step, row(band).over(window))
    return F.max(band).over(window.rangeBetween(step, step))


def filled(df: DataFrame, block: int, halo: int, width: int, wrap_x: bool = False) -> DataFrame:
    """Give the rows of a block a cell of NULLs at each place along x where none is, so that a second pass along y may stand there.

    Only gaps are made, from one cell to the next of its row, and ``core`` drops them again.
    """
    lo, hi = F.col("_bx") * block - halo, F.least((F.col("_bx") + 1) * block, F.lit(width)) + halo - 1
    if not wrap_x:
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(width - 1))
    places, none = F.col("_x"), F.array().cast("array<int>")
    df = df.withColumns({"_before": F.lag("_x").over(along_x()), "_after": F.lead("_x").over(along_x())})
    until = F.coalesce(F.col("_after"), hi + 1)
    left = F.when(F.col("_before").isNull() & (lo < places), F.sequence(lo, places - 1)).otherwise(none)
    right = F.when(until > places + 1, F.sequence(places + 1, until - 1)).otherwise(none)
    df = df.withColumn("_at", F.explode(F.concat(F.array(places), left, right)))
    own = F.col("_at") == F.col("_x")
    return df.select(GRID, *BLOCK, "y", F.col("_at").alias("_x"), *[
        F.when(own, F.col(c)).alias(c) for c in df.columns if c not in (GRID, *BLOCK, "y", "_x", "_at", "_before", "_after")])


def max_filter(cells: DataFrame, outputs: dict[str, tuple[str, int]], height: int, width: int, block: int = 64) -> DataFrame:
    """Add maxima over square neighbourhoods, cut at the edges; NULL and absent cells are skipped.

    ``outputs`` maps a new column to (band, size). Filters of several sizes share the one shuffle.
    """
    widest = max(size for _, size in outputs.values()) // 2
    df = filled(with_halo(cells, block, widest, height, width), block, widest, width)
    for axis, window in enumerate((along_x(), along_y())):
        df = df.withColumns({
            out: F.max(band if axis == 0 else out).over(window.rangeBetween(-(size // 2), size // 2))
            for out, (band, size) in outputs.items()})
    return core(df, block).select(*cells.columns, *outputs)


def fill_holes(cells: DataFrame, band: str, steps: int, height: int, width: int, block: int = 64) -> DataFrame:
    """Grow valid cells into missing ones ``steps`` times: the mean of the valid 4-neighbours.

    All missing cells of a step change together. What is still missing at the end becomes 0. A cell that has no row gets
    none, and lends nothing to its neighbours.
    """
    df = with_halo(cells, block, steps, height, width)
    for _ in range(steps):
        near = [beside(band, step, axis) for axis in ("_x", "y") for step in (-1, 1)]
        df = df.withColumns({f"_n{i}": c for i, c in enumerate(near)})
        names = [F.col(f"_n{i}") for i in range(4)]
        total = sum((F.coalesce(c, F.lit(0.0)) for c in names[1:]), F.coalesce(names[0], F.lit(0.0)))
        count = sum((c.isNotNull().cast("int") for c in names[1:]), names[0].isNotNull().cast("int"))
        df = df.withColumn(band, F.coalesce(F.col(band), F.when(count > 0, total / count)))
        df = df.drop(*[f"_n{i}" for i in range(4)])
    return core(df, block).withColumn(band, F.coalesce(F.col(band), F.lit(0.0)))


def min_corners(cells: DataFrame, bands: list[str], radius: int, height: int, width: int, block: int = 64) -> DataFrame:
    """Per band the minimum of the four diagonal neighbours at ``radius`` that there are; x wraps, y clamps."""
    df = filled(with_halo(cells, block, radius, height, width, wrap_x=True), block, radius, width, wrap_x=True)
    df = df.withColumns({f"_s_{b}": F.least(beside(b, -radius, "_x"), beside(b, radius, "_x")) for b in bands})

    def clamped(band: str, step: int, edge: int) -> Column:
        # Where the row would lie beyond an edge, the row at the edge itself stands for it.
        span = along_y().rangeBetween(min(step, 0), max(step, 0))
        inside = (F.col("y") + step).between(0, height - 1)
        return F.when(inside, beside(band, step, "y")).otherwise(F.max(F.when(F.col("y") == edge, F.col(band))).over(span))

    df = df.withColumns({b: F.least(clamped(f"_s_{b}", -radius, 0), clamped(f"_s_{b}", radius, height - 1)) for b in bands})
    return core(df.drop(*[f"_s_{b}" for b in bands]), block).select(*cells.columns)


def slope_normals(cells: DataFrame, band: str, height: int, width: int, x_scale: float = 0.4,
                  y_scale: float = 0.8, block: int = 64) -> DataFrame:
    """Unit normals of a relief field; x wraps, y differences are one-sided at the edges."""
    df = with_halo(cells, block, 1, height, width, wrap_x=True)
    df = df.withColumns({
        "_e": beside(band, 1, "_x"), "_w": beside(band, -1, "_x"), "_s": beside(band, 1, "y"), "_n": beside(band, -1, "y")})
    dx = (F.col("_e") - F.col("_w")) * x_scale
    dy = F.when(F.col("_n").isNull(), F.col("_s") - F.col(band)) \
        .when(F.col("_s").isNull(), F.col(band) - F.col("_n")) \
        .otherwise((F.col("_s") - F.col("_n")) / 2.0) * y_scale
    return core(_normal(df, dx, dy).drop("_e", "_w", "_s", "_n"), block)


def sphere_normals(cells: DataFrame, band: str, height: int, width: int, exaggeration: float = 1.0,
                   radius_m: float = 6_378_137.0, block: int = 64) -> DataFrame:
    """Unit normals (east, north, up) of heights in metres on the sphere; the grid spacing is never under 100 m."""
    df = with_halo(cells, block, 1, height, width, wrap_x=True)
    df = df.withColumns({
        "_e": beside(band, 1, "_x"), "_w": beside(band, -1, "_x"), "_s": beside(band, 1, "y"), "_n": beside(band, -1, "y")})
    lat = F.radians(90.0 - (F.col("y") + 0.5) * (180.0 / height))
    step_x = F.greatest(F.lit(100.0), radius_m * F.cos(lat) * (2 * math.pi / width))
    step_y = radius_m * math.pi / height
    span = F.col("_n").isNotNull().cast("int") + F.col("_s").isNotNull().cast("int")
    east = exaggeration * (F.col("_e") - F.col("_w")) / (2.0 * step_x)
    north = F.coalesce(exaggeration * (F.coalesce("_n", band) - F.coalesce("_s", band)) / (F.nullif(span, F.lit(0)) * step_y),
                       F.lit(0.0))
    return core(_normal(df, east, north).drop("_e", "_w", "_s", "_n"), block)


def _normal(df: DataFrame, dx: Column, dy: Column) -> DataFrame:
    df = df.withColumns({"_dx": dx, "_dy": dy})
    length = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") + 1.0)
    return df.withColumns({"nx": -F.col("_dx") / length, "ny": -F.col("_dy") / length, "nz": 1.0 / length}) \
        .drop("_dx", "_dy")


def polar_lowpass(cells: DataFrame, bands: list[str], height: int, width: int) -> DataFrame:
    """Box mean along each row whose width grows as 1/cos(latitude), cyclic; rows under 2 are kept.

    The boxes of a row are equally wide, so a cell enters the sum at one column and leaves it at another. Both are
    events at columns, and a running sum over the row's events, read at each cell, is the sum of its box: the cost grows
    with the row, whatever the width of its box. NULL and absent cells count in no mean. The unit is a row of one grid.
    """
    lat = F.radians(90.0 - (F.col("y") + 0.5) * (180.0 / height))
    wide = F.rint(F.least(1.0 / F.greatest(F.cos(lat), F.lit(1e-6)), F.lit(width / 2.0))).cast("int")
    df = cells.withColumn("_k", wide)
    x, k = F.col("x"), F.col("_k")
    half = F.floor(k / 2).cast("int")
    enters, leaves = x + half + 1 - k, x + half + 1  # columns whose boxes hold the cell: from, and no longer from
    event = lambda at, sign: F.struct(at.alias("at"), F.lit(sign).alias("sign"))
    turned = F.when(enters < 0, enters + width).otherwise(enters), F.when(leaves > width, leaves - width).otherwise(leaves)
    moves = F.array(event(turned[0], 1), event(turned[1], -1))
    moves = F.when((enters < 0) | (leaves > width), F.concat(moves, F.array(event(F.lit(0), 1)))).otherwise(moves)
    here = F.array(event(x, 0))
    df = df.withColumn("_e", F.explode(F.when(k >= 2, F.concat(moves, here)).otherwise(here)))
    df = df.select(*cells.columns, "_k", F.col("_e.at").alias("_at"), F.col("_e.sign").alias("_sign"))
    upto = Window.partitionBy(GRID, "y").orderBy("_at", (F.col("_sign") == 0)).rowsBetween(Window.unboundedPreceding, 0)
    sums = {}
    for b in bands:
        sums[f"_t_{b}"] = F.sum(F.col(b) * F.col("_sign")).over(upto)
        sums[f"_n_{b}"] = F.sum(F.when(F.col(b).isNotNull(), F.col("_sign"))).over(upto)
    out = df.withColumns(sums).where(F.col("_sign") == 0)
    mean = {b: F.when(F.col("_k") < 2, F.col(b)).when(F.col(f"_n_{b}") > 0, F.col(f"_t_{b}") / F.col(f"_n_{b}")) for b in bands}
    return out.withColumns(mean).select(*cells.columns)


def wrap_edges(cells: DataFrame, bands: list[str], width: int, ramp: int = 8) -> DataFrame:
    """Fade the first and last ``ramp`` columns of each row to their common mean at the antimeridian."""
    edge = (F.col("x") < ramp) | (F.col("x") >= width - ramp)
    strip = cells.where(edge)
    row = Window.partitionBy(GRID, "y")
    t = F.when(F.col("x") < ramp, F.col("x") / float(ramp - 1)).otherwise((width - 1 - F.col("x")) / float(ramp - 1))
    strip = strip.withColumn("_t", t)
    strip = strip.withColumns({f"_c_{b}": F.avg(b).over(row) for b in bands})
    strip = strip.withColumns({b: F.col(f"_c_{b}") * (1.0 - F.col("_t")) + F.col(b) * F.col("_t") for b in bands})
    strip = strip.drop("_t", *[f"_c_{b}" for b in bands])
    inside = cells.where(~edge).withColumns({b: F.col(b).cast("double") for b in bands})
    return inside.unionByName(strip)


def sliding_median(df: DataFrame, by: list[str], order: str, value: str, half: int, min_n: int,
                   limit: float, out: str) -> DataFrame:
    """Median of the ``2*half+1`` rows round each row, clipped; 0 where fewer than ``min_n`` are valid."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    median = F.percentile(value, F.lit(0.5)).over(frame)
    clipped = F.greatest(F.lit(-limit), F.least(F.lit(limit), median))
    return df.withColumn(out, F.when(F.count(value).over(frame) >= min_n, clipped).otherwise(F.lit(0.0)))


def bartlett(df: DataFrame, by: list[str], order: str, value: str, half: int, out: str) -> DataFrame:
    """Triangular smoothing over ``2*half+1`` rows, zero beyond the ends; the weights sum to 1."""
    rows = Window.partitionBy(*by).orderBy(order)
    total = F.col(value) * F.lit(1.0 / half)
    for k in range(1, half):
        weight = (1.0 - k / half) / half
        pair = F.coalesce(F.lag(value, k).over(rows), F.lit(0.0)) + F.coalesce(F.lead(value, k).over(rows), F.lit(0.0))
        total = total + pair * F.lit(weight)
    return df.withColumn(out, total)


def box_radius(sigma: float, passes: int = 3) -> tuple[int, float]:
    """Whole radius and edge weight of the extended box whose repeated passes have this sigma."""
    variance = sigma * sigma / passes
    whole = int(math.floor((math.sqrt(12.0 * variance + 1.0) - 1.0) / 2.0))
    edge = (2 * whole + 1) * (whole * (whole + 1) - 3.0 * variance) / (6.0 * (variance - (whole + 1) ** 2))
    return whole, edge


def gaussian(cells: DataFrame, band: str, sigma: float, height: int, width: int, wrap_x: bool = False,
             passes: int = 3) -> DataFrame:
    """Gaussian blur of a dense grid as three extended box passes per axis; edge pixels are repeated, or x wraps.

    Box sums are differences of running sums, so the cost does not depend on sigma. The unit is a
    row, then a column, of one grid.
    """
    whole, edge = box_radius(sigma, passes)
    keep = [c for c in cells.columns if c != band]
    pad = passes * (whole + 1) if wrap_x else 0
    around = -(-pad // width)
    turns = F.filter(F.array(*[F.lit(k) for k in range(-around, around + 1)]),
                     lambda k: (F.col("x") + k * width).between(-pad, width + pad - 1))
    df = cells.select(*keep, band, (F.explode(turns) if wrap_x else F.lit(0)).alias("_turn"))
    df = df.select("*", (F.col("x") + F.col("_turn") * width).alias("_px"))
    for axis, other, low, count in (("_px", "y", -pad, width + 2 * pad), ("y", "_px", 0, height)):
        order = Window.partitionBy(GRID, other).orderBy(axis)
        for _ in range(passes):
            df = _box_pass(df, [*keep, "_turn", "_px"], band, order, F.col(axis) - low, count, whole, edge)
        if axis == "_px":
            df = df.where(F.col("_turn") == 0)
    return df.select(*cells.columns)


def _box_pass(df: DataFrame, keep: list[str], band: str, order, i: Column, n: int, whole: int, edge: float) -> DataFrame:
    """One box pass along ``order``; ``i`` is the 0-based place on the axis of ``n`` places."""
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.select(
        *keep, band, F.sum(band).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_cs"),
        F.sum(band).over(everything).alias("_all"), F.first(band).over(everything).alias("_first"),
        F.last(band).over(everything).alias("_last"))
    upto = F.coalesce(F.lead("_cs", whole).over(order), F.col("_all")) if whole else F.col("_cs")
    before = F.coalesce(F.lag("_cs", whole + 1).over(order), F.lit(0.0))
    beyond = F.greatest(F.lit(0), whole - i) * F.col("_first") + F.greatest(F.lit(0), i + whole + 1 - n) * F.col("_last")
    tips = F.coalesce(F.lag(band, whole + 1).over(order), F.col("_first")) \
        + F.coalesce(F.lead(band, whole + 1).over(order), F.col("_last"))
    return df.select(*keep, ((upto - before + beyond + edge * tips) / (2 * whole + 1 + 2 * edge)).alias(band))
