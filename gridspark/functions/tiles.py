"""Tile keys: (layer, mip, x, y), ordered by layer, mip, row, column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, lit

KEY = ["layer", "mip", "y", "x"]

# Pixels of a tile interior and of its border on each side.
TILE, GUTTER = 256, 4
# Container limits and the known layer flag bits.
ALIGNMENT, MAX_MIPS, FLAG_BITS = 16, 16, 7
# Bytes per 4x4 block of each block format; R16 stores two bytes per pixel.
BLOCK_BYTES = {"BC1": 8, "BC4": 8, "BC7": 16, "BC5": 16}
# The channel names in code order and the formats each accepts.
CHANNEL_FORMATS = {
    "day_color": ["BC7"],
    "surface_normal": ["BC5"],
    "night_emission": ["BC7", "BC4"],
    "water_mask": ["BC4"],
    "cloud_density": ["BC4"],
    "cloud_normal": ["BC5"],
    "height": ["R16"],
    "star_panorama": ["BC1", "BC7"],
    "city_cloud_glow": ["BC7"],
    "aurora_mask": ["BC4"],
    "aurora_color": ["BC7"],
    "lightning_mask": ["BC4"],
}


def mip_size(base: Column | str, mip: Column | str) -> Column:
    """Extent of a level: the base halved, rounding up, never under one."""
    base, mip = col(base).cast("bigint"), col(mip).cast("int")
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), mip)
    return F.greatest(F.lit(1).cast("bigint"), F.ceil((base + step - 1 - F.pmod(base + step - 1, step)) / step))


def tiles_across(base, mip, tile: int = TILE) -> Column:
    """Tiles needed along one axis of a level."""
    return F.ceil(mip_size(base, mip) / float(tile))


def tiles_in_level(base_w, base_h, mip, tile: int = TILE) -> Column:
    return (tiles_across(base_w, mip, tile) * tiles_across(base_h, mip, tile)).cast("bigint")


def full_mip_count(base_w, base_h) -> Column:
    """Levels of a complete pyramid down to 1x1."""
    largest = F.greatest(col(base_w), col(base_h)).cast("bigint")
    levels = F.sequence(F.lit(0), F.lit(31))
    halvings = F.filter(levels, lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k) < largest)
    return (F.size(halvings) + 1).cast("int")


def pyramid_tiles(base_w, base_h, mips, tile: int = TILE) -> Column:
    """Tiles of all ``mips`` levels; with ``mips`` = the current level this is its base ordinal."""
    mips = col(mips)
    levels = F.when(mips > 0, F.sequence(F.lit(0), mips - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, F.lit(0).cast("bigint"),
                       lambda s, k: s + tiles_in_level(base_w, base_h, k, tile))


def ancestor(x: Column | str, levels: Column | str) -> Column:
    """Coordinate of the ancestor ``levels`` above."""
    return F.call_function("shiftright", col(x), col(levels))


def in_grid(base_w, base_h, mip_count, mip, x, y, tile: int = TILE) -> Column:
    mip, x, y = col(mip), col(x), col(y)
    return ((mip >= 0) & (mip < col(mip_count)) & (x >= 0) & (y >= 0)
            & (x < tiles_across(base_w, mip, tile)) & (y < tiles_across(base_h, mip, tile)))


def tile_bytes(fmt: Column | str, extent: int = TILE + 2 * GUTTER) -> Column:
    """Fixed payload size of one padded tile; NULL for an unknown format."""
    fmt = col(fmt)
    blocks = (extent // 4) ** 2
    out = F.when(fmt == "R16", F.lit(extent * extent * 2))
    for name, size in BLOCK_BYTES.items():
        out = out.when(fmt == name, F.lit(blocks * size))
    return out.cast("bigint")


def accepts_format(channel: Column | str, fmt: Column | str) -> Column:
    channel, fmt = col(channel), col(fmt)
    out = F.lit(False)
    for name, formats in CHANNEL_FORMATS.items():
        out = out | ((channel == name) & fmt.isin(formats))
    return out


def has_unknown_flags(flags: Column | str, known: int = FLAG_BITS) -> Column:
    return col(flags).bitwiseAND(F.bitwise_not(F.lit(known))) != 0


def uv_tile_wrapped(u: Column | str, tiles: Column) -> Column:
    """Tile of a texture coordinate on the cyclic axis."""
    return F.pmod(F.floor(_unit(u) * lit(tiles)), lit(tiles)).cast("int")


def uv_tile_clamped(v: Column | str, tiles: Column) -> Column:
    return F.floor(_unit(v) * lit(tiles)).cast("int")


def _unit(u) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0 - 2.0 ** -23), col(u)))


def footprint_mip(du_dx, dv_dx, du_dy, dv_dy, base_w, base_h, mip_count, bias: float = 0.0) -> Column:
    """Level whose texels match the larger of the two pixel footprints."""
    fx = F.hypot(col(du_dx) * col(base_w), col(dv_dx) * col(base_h))
    fy = F.hypot(col(du_dy) * col(base_w), col(dv_dy) * col(base_h))
    texels = F.greatest(F.lit(1.0), fx, fy)
    mip = F.greatest(F.lit(0), F.floor(F.log2(texels) + bias))
    return F.least(mip, col(mip_count) - 1).cast("int")
