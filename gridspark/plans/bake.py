"""Raster bakes: the day colour pyramid, relief, and re-tiling of coded blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import linear_to_srgb, srgb_to_linear
from ..operators import pyramid as P
from ..operators.kernels import sphere_normals
from ..operators.regrid import regrid_area
from ..session import cut_lineage
from .masks import water_by_elevation

KEY = ["grid_id", "y", "x"]


def half_up(c: Column) -> Column:
    """Nearest byte, halves up, free of the noise of the weighted sum."""
    return F.floor(F.round(c, 6) + 0.5).cast("int")


def day_tiles(frame: DataFrame, source: tuple[int, int], target: tuple[int, int], tile: int, gutter: int) -> DataFrame:
    """(grid, mip, ty, tx, payload, content_hash) of colour and water mask (r, g, b, elev in).

    Colour is averaged in linear light, the mask plainly; every level no smaller than a tile is cut into
    tiles with borders.
    """
    rgb = ["r", "g", "b"]
    lit = frame.select(*KEY, *[srgb_to_linear(c).alias(c) for c in rgb],
                       F.when(water_by_elevation("r", "g", "b", "elev"), 255.0).otherwise(0.0).alias("mask"))
    base = regrid_area(lit, [*rgb, "mask"], source, target)
    base = base.select(*KEY, *[half_up(linear_to_srgb(c) * 255.0).alias(c) for c in rgb], half_up(F.col("mask")).alias("mask"))
    levels = cut_lineage(P.build_pyramid(cut_lineage(base), rgb, ["mask"], *target, rounding="half_up"))
    out = None
    for mip, (h, w) in enumerate(P.level_sizes(*target)):
        if min(h, w) < tile:
            break
        padded = P.with_gutter(levels.where(F.col("mip") == mip), h, w, tile, gutter)
        tiles = P.tile_payloads(padded, P.texel_hex([*rgb, "mask"]))
        out = tiles if out is None else out.unionByName(tiles)
    return out


def relief_levels(frame: DataFrame, source: tuple[int, int], target: tuple[int, int], exaggeration: float = 1.0) -> DataFrame:
    """(grid, mip, y, x, nx, ny) bytes of surface normals; the sea surface is flat."""
    heights = frame.select(*KEY, F.greatest(F.col("elev"), F.lit(0.0)).alias("h"))
    smooth = regrid_area(heights, ["h"], source, target)
    normals = sphere_normals(smooth, "h", *target, exaggeration=exaggeration)
    base = normals.select(*KEY, *[half_up((F.col(c) * 0.5 + 0.5) * 255.0).alias(c) for c in ("nx", "ny")])
    return P.build_pyramid(cut_lineage(base), [], ["nx", "ny"], *target, rounding="half_up")


def block_rows(cells: DataFrame, layers: dict[int, tuple[str, int]], height: int, width: int, block: int = 4) -> DataFrame:
    """(grid_id, layer, mip, y, w, h, block_bytes, payload, columns): stored rows of coded blocks, as a block map holds them.

    ``layers`` maps an id to (byte band, bytes of a block); the code of a block is its first texels, row by row.
    Absent blocks are not stored: ``columns`` lists those that are, in order, and is NULL where a row is whole.
    """
    bands = F.array(*[F.struct(F.lit(i).alias("layer"), F.lit(n).alias("block_bytes"), F.col(b).alias("v")) for i, (b, n) in layers.items()])
    texels = cells.select(*KEY, F.inline(bands)).withColumn("p", (F.col("y") % block) * block + F.col("x") % block).where("p < block_bytes")
    place = F.struct(F.floor(F.col("x") / block).alias("bx"), "p", F.lpad(F.hex("v"), 2, "0").alias("h"))
    rows = texels.groupBy("grid_id", "layer", "block_bytes", F.floor(F.col("y") / block).cast("int").alias("y")).agg(
        F.array_sort(F.collect_list(place)).alias("t"))  # a row of one grid
    payload = F.unhex(F.array_join(F.transform("t", lambda t: t["h"]), ""))
    columns = F.array_distinct(F.transform("t", lambda t: t["bx"].cast("int")))
    return rows.select("grid_id", "layer", F.lit(0).alias("mip"), "y", F.lit(width // block).alias("w"), F.lit(height // block).alias("h"),
                       "block_bytes", payload.alias("payload"), F.when(F.size(columns) < width // block, columns).alias("columns"))


def retile_blocks(rows: DataFrame, tile: int, gutter: int) -> DataFrame:
    """(grid_id, layer, mip, ty, tx, payload, content_hash): tiles re-cut from stored rows of blocks, never decoding one.

    ``rows`` is as ``block_rows`` gives it: a row of ``w`` blocks of ``block_bytes`` each, one of ``h``. A padded tile is
    ``tile`` blocks and a gutter of ``gutter`` on every side, in blocks. It takes one slice of bytes from each of its rows:
    x wraps round, so a slice is cut from as many turns of the row as it needs, and y repeats the edge, so the first and the
    last row are taken more than once. Slices are moved once, to their tile. Where a row lists its ``columns``, blocks it does
    not hold are left out of the slice.
    """
    span = tile + 2 * gutter
    y, h, w = F.col("y"), F.col("h"), F.col("w")
    last = F.floor((h - 1) / tile).cast("int")
    near = F.sequence(F.greatest(F.lit(0), F.floor((y - gutter) / tile).cast("int")), F.least(last, F.floor((y + gutter) / tile).cast("int")))
    out = rows.withColumn("ty", F.explode(near))
    at = y - F.col("ty") * tile + gutter
    low = F.when((y == 0) & (F.col("ty") == 0), F.lit(0)).otherwise(F.greatest(at, F.lit(0)))
    high = F.when(y == h - 1, F.lit(span - 1)).otherwise(F.least(at, F.lit(span - 1)))
    out = out.withColumn("tx", F.explode(F.sequence(F.lit(0), F.floor((w - 1) / tile).cast("int"))))
    start = F.pmod(F.col("tx") * tile - gutter, w)
    turns = F.aggregate(F.sequence(F.lit(1), F.ceil((start + span) / w).cast("int")), F.lit(b""), lambda held, _: F.concat(held, F.col("payload")))
    size = F.col("block_bytes")
    whole_slice = F.substring(turns, (start * size + 1).cast("int"), (F.lit(span) * size).cast("int"))
    if "columns" in rows.columns:
        at_column = lambda i: F.array_position("columns", F.pmod(start + i, w).cast("int")).cast("int")
        held = F.filter(F.transform(F.sequence(F.lit(0), F.lit(span - 1)), at_column), lambda p: p > 0)
        present = F.aggregate(held, F.lit(b""), lambda cut, p: F.concat(cut, F.substring("payload", (p - 1) * size + 1, size)))
        whole_slice = F.when(F.col("columns").isNull(), whole_slice).otherwise(present)
    slices = out.select(*[c for c in ("grid_id", "layer", "mip", "ty", "tx")], F.sequence(low, high).alias("_rows"),
                        whole_slice.alias("_bytes"))
    tiles = slices.groupBy("grid_id", "layer", "mip", "ty", "tx").agg(F.array_sort(F.collect_list(F.struct(
        F.element_at("_rows", 1).alias("at"), F.size("_rows").alias("many"), "_bytes"))).alias("_s"))  # a slice a row of the tile
    whole = F.aggregate("_s", F.lit(b""), lambda held, s: F.aggregate(
        F.sequence(F.lit(1), s["many"]), held, lambda more, _: F.concat(more, s["_bytes"])))
    return tiles.select("grid_id", "layer", "mip", "ty", "tx", whole.alias("payload")).withColumn("content_hash", F.sha2("payload", 256))
