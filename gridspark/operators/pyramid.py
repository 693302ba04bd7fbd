"""Mip pyramids: levels, tiles with borders, indexes and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiles as T
from ..functions.colour import linear_to_srgb, srgb_to_linear
from ..session import cut_lineage, literal_table, small
from .ordered import global_order, neighbour, running

GRID = "grid_id"


def level_sizes(height: int, width: int, stop: int = 1, odd: str = "clamp") -> list[tuple[int, int]]:
    """(height, width) of each level down to 1x1, or until a side would fall under ``stop``."""
    sizes = [(height, width)]
    while True:
        h, w = sizes[-1]
        if h == 1 and w == 1:
            return sizes
        nh, nw = ((h + 1) // 2, (w + 1) // 2) if odd == "clamp" else (max(1, h // 2), max(1, w // 2))
        if stop > 1 and (min(nh, nw) < stop or nh % stop or nw % stop):
            return sizes
        sizes.append((nh, nw))


def mip_reduce(cells: DataFrame, srgb_bands: list[str], plain_bands: list[str], height: int, width: int,
               odd: str = "clamp", rounding: str = "even") -> DataFrame:
    """One level: byte bands averaged 2x2, colour bands in linear light, requantised.

    An odd last row or column is averaged with itself (``clamp``) or left out (``cut``). Partial
    aggregation runs before the one shuffle.
    """
    if odd == "cut":
        cells = cells.where((F.col("y") < max(1, height // 2 * 2)) & (F.col("x") < max(1, width // 2 * 2)))

    def whole(c: Column) -> Column:
        return (F.floor(c + 0.5) if rounding == "half_up" else F.rint(c)).cast("int")

    # The mean of a few bytes is exact in a double, so ties of plain bands round as they should.
    means = [F.avg(srgb_to_linear(b)).alias(b) for b in srgb_bands] + [F.avg(b).alias(b) for b in plain_bands]
    out = cells.groupBy(GRID, F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x")).agg(*means)
    return out.withColumns({**{b: whole(linear_to_srgb(b) * 255.0) for b in srgb_bands},
                            **{b: whole(F.col(b)) for b in plain_bands}})


def build_pyramid(cells: DataFrame, srgb_bands: list[str], plain_bands: list[str], height: int, width: int,
                  stop: int = 1, odd: str = "clamp", rounding: str = "even", cut_every: int = 2) -> DataFrame:
    """All levels with a ``mip`` column. Each level is quantised before the next is made from it.

    Levels shrink four-fold; lineage is cut to the checkpoint folder every ``cut_every`` levels so a
    coarse level does not recompute the chain from the base.
    """
    bands = srgb_bands + plain_bands
    sizes = level_sizes(height, width, stop, odd)
    level = cells.select(GRID, "y", "x", *bands)
    out = level.withColumn("mip", F.lit(0))
    for mip in range(1, len(sizes)):
        h, w = sizes[mip - 1]
        level = mip_reduce(level, srgb_bands, plain_bands, h, w, odd, rounding)
        if mip % cut_every == 0 and mip < len(sizes) - 1:
            level = cut_lineage(level)
        out = out.unionByName(level.withColumn("mip", F.lit(mip)))
    return out.select(GRID, "mip", "y", "x", *bands)


def place_tiles(cells: DataFrame, placement: DataFrame, tile_h: int, tile_w: int) -> DataFrame:
    """Cells of named source tiles to global coordinates through a (name, row, col) table, broadcast if it is small."""
    return (cells.join(small(placement, placement.count()), "name")
            .withColumns({"y": F.col("y") + F.col("row") * tile_h, "x": F.col("x") + F.col("col") * tile_w})
            .drop("row", "col", "name"))


def gutter_axis(extent: int, tile: int, gutter: int, wrap: bool) -> list[tuple[int, int, int]]:
    """(source, tile, local) of one axis: which padded tiles hold a row or column, and where.

    Positions beyond the axis wrap or repeat the edge.
    """
    out = []
    for t in range(-(-extent // tile)):
        for local in range(tile + 2 * gutter):
            p = t * tile + local - gutter
            out.append((p % extent if wrap else min(extent - 1, max(0, p)), t, local))
    return out


def with_gutter(cells: DataFrame, height: int, width: int, tile: int = T.TILE, gutter: int = T.GUTTER) -> DataFrame:
    """Each cell in every padded tile that shows it; x wraps, y repeats the edge.

    Two broadcast equality joins with axis tables whose size depends on the grid extent only: no
    shuffle until tiles are assembled.
    """
    spark = cells.sparkSession
    ty = literal_table(spark, gutter_axis(height, tile, gutter, False), "_sy int, ty int, ly int")
    tx = literal_table(spark, gutter_axis(width, tile, gutter, True), "_sx int, tx int, lx int")
    return (cells.join(ty, cells["y"] == ty["_sy"]).join(tx, cells["x"] == tx["_sx"]).drop("_sy", "_sx", "y", "x"))


def texel_hex(bands: list[str]) -> Column:
    """The byte bands of a cell as interleaved hexadecimal digits."""
    return F.concat(*[F.lpad(F.hex(F.col(b).cast("int")), 2, "0") for b in bands])


def tile_payloads(padded: DataFrame, pixel: Column) -> DataFrame:
    """One row per padded tile: its units (hexadecimal ``pixel``) in row order, and their SHA-256.

    A tile holds a fixed number of units. Rows are assembled first, then the tile from its rows.
    """
    keys = [c for c in (GRID, "layer", "mip") if c in padded.columns] + ["ty", "tx"]
    rows = padded.groupBy(*keys, "ly").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lx", pixel.alias("p")))), lambda s: s["p"]), "").alias("h"))
    tiles = rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ly", "h"))), lambda s: s["h"]), "").alias("h"))
    payload = F.unhex("h")
    return tiles.select(*keys, payload.alias("payload"), F.sha2(payload, 256).alias("content_hash"))


def layer_bases(layers: DataFrame, tile: int = T.TILE) -> DataFrame:
    """First index, tile count and byte base of each layer, in layer order."""
    sized = layers.withColumns({
        "index_count": T.pyramid_tiles("base_w", "base_h", "mip_count", tile),
        "tile_bytes": T.tile_bytes("format")})
    size = F.col("index_count") * F.col("tile_bytes")
    ranked = global_order(sized, ["layer"], {"_tiles": F.col("index_count"), "_bytes": size}, rank="_rank")
    return ranked.withColumns({"first_index": F.col("_tiles") - F.col("index_count"), "byte_base": F.col("_bytes") - size}) \
        .drop("_rank", "_tiles", "_bytes")


def expected_tiles(layers: DataFrame, tile: int = T.TILE) -> DataFrame:
    """Every key of the complete pyramid of each layer (base_w, base_h, mip_count)."""
    lv = layers.withColumn("mip", F.explode(F.sequence(F.lit(0), F.col("mip_count") - 1)))
    lv = lv.withColumn("_tx", T.tiles_across("base_w", "mip", tile).cast("int")) \
        .withColumn("_ty", T.tiles_across("base_h", "mip", tile).cast("int"))
    return (lv.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("_ty") - 1)))
            .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("_tx") - 1))).drop("_tx", "_ty"))


def index_tiles(tiles: DataFrame, layers: DataFrame, tile: int = T.TILE, payload_base: int = 0) -> DataFrame:
    """Index entries of a complete pyramid in canonical order.

    The ordinal of a tile follows from its key (levels before it, rows before it, column), so offsets
    need no ordered scan. ``layers`` carries base_w, base_h, tile_bytes and byte_base.
    """
    joined = tiles.join(layers.select("layer", "base_w", "base_h", "tile_bytes", "byte_base"), "layer")
    ordinal = T.pyramid_tiles("base_w", "base_h", "mip", tile) \
        + F.col("y") * T.tiles_across("base_w", "mip", tile).cast("bigint") + F.col("x")
    return joined.select(*tiles.columns, F.lit(0).alias("flags"),
                         (F.col("byte_base") + payload_base + ordinal * F.col("tile_bytes")).alias("payload_offset"),
                         F.col("tile_bytes").alias("payload_bytes"))


def aligned_offsets(files: DataFrame, order: list[str], size: str, alignment: int = T.ALIGNMENT) -> DataFrame:
    """Running aligned offset of payloads of any size over one global order."""
    padded = F.ceil(F.col(size) / float(alignment)).cast("bigint") * alignment
    out = global_order(files, list(order), {"_end": padded}, rank="ordinal")
    return out.withColumn("payload_offset", F.col("_end") - padded).drop("_end")


def pyramid_tail(index: DataFrame, layers: DataFrame, tail_width: int) -> DataFrame:
    """Index entries of the levels no wider than ``tail_width``, offsets counted from the first kept."""
    kept = (index.join(layers.select("layer", "base_w"), "layer")
            .where(T.mip_size("base_w", "mip") <= tail_width).drop("base_w"))
    start = kept.groupBy("layer").agg(F.min("payload_offset").alias("_start"))
    return kept.join(start, "layer").withColumn("tail_offset", F.col("payload_offset") - F.col("_start")).drop("_start")


def audit_pyramid(tiles: DataFrame, layers: DataFrame, tile: int = T.TILE) -> DataFrame:
    """(key, verdict): ``missing`` and ``extra`` against the complete pyramid, ``duplicate`` keys.

    Present tiles are reduced to one row per key first, so a key repeated many times costs no more.
    """
    want = expected_tiles(layers, tile).select("layer", "mip", "y", "x", F.lit(1).alias("_w"))
    have = tiles.groupBy(*T.KEY).agg(F.count(F.lit(1)).alias("n"))
    both = want.join(have, T.KEY, "full_outer")
    verdicts = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "missing"), F.when(F.col("_w").isNull(), "extra"), F.when(F.col("n") > 1, "duplicate")))
    return both.select(*T.KEY, F.explode(verdicts).alias("verdict"))


def audit_layers(layers: DataFrame, by: list[str], tile: int = T.TILE, chunk: float = 4096.0) -> DataFrame:
    """First broken rule of each layer row, or ``ok``. ``pos`` is the position in its directory."""
    full = T.full_mip_count("base_w", "base_h")
    # A directory is short by contract, but a broken one need not be: the scans do not rely on it.
    counted = neighbour(layers, by, ["pos"], chunk, {"_prev": F.col("layer")}, offset=-1)
    counted = running(counted, by, ["pos"], chunk, {"_sum": ("sum", F.col("index_count"))}, inclusive=False)
    repeats = layers.groupBy(*by, "channel").agg(F.count(F.lit(1)).alias("_same"))
    counted = counted.join(repeats, [*by, "channel"]).withColumn("_next_first", F.coalesce("_sum", F.lit(0)))
    rule = (F.when(F.col("layer") <= F.col("_prev"), "ids must ascend")
            .when((F.col("base_w") <= 0) | (F.col("base_h") <= 0), "empty base")
            .when(F.col("mip_count") != full, "incomplete mips")
            .when(~T.accepts_format("channel", "format"), "format not accepted")
            .when(T.has_unknown_flags("flags"), "unknown flags")
            .when(F.col("first_index") != F.col("_next_first"), "index range not contiguous")
            .when(F.col("index_count") != T.pyramid_tiles("base_w", "base_h", "mip_count", tile), "tile count")
            .when(F.col("_same") > 1, "channel repeated").otherwise("ok"))
    return counted.select(*layers.columns, rule.alias("rule"))


def audit_index(index: DataFrame, layers: DataFrame, payload_base: int, file_bytes: int,
                chunk: float = float(1 << 20), tile: int = T.TILE) -> DataFrame:
    """First broken rule of each index entry, or ``ok``.

    ``layers`` (layer, base_w, base_h, mip_count, format) is one row per layer. The order rule looks
    at the entry before, found across chunk edges.
    """
    prev = neighbour(index, ["layer"], ["pos"], chunk,
                     {"_pm": F.col("mip"), "_py": F.col("y"), "_px": F.col("x")}, offset=-1)
    j = prev.join(layers, "layer", "left")
    here, before = F.struct("mip", "y", "x"), F.struct(F.col("_pm"), F.col("_py"), F.col("_px"))
    rule = (F.when(F.col("base_w").isNull(), "unknown layer")
            .when(~T.in_grid("base_w", "base_h", "mip_count", "mip", "x", "y", tile), "outside its grid")
            .when(F.col("_pm").isNotNull() & (here <= before), "not in order")
            .when(F.col("flags") != 0, "unknown flags")
            .when(F.col("payload_offset") < payload_base, "before the payload region")
            .when(F.pmod(F.col("payload_offset"), F.lit(T.ALIGNMENT)) != 0, "not aligned")
            .when(F.col("payload_bytes") != T.tile_bytes("format"), "wrong size")
            .when(F.col("payload_offset") + F.col("payload_bytes") > file_bytes, "beyond the file")
            .otherwise("ok"))
    return j.withColumn("rule", rule).select(*index.columns, "rule")


def mips_ok(sidecars: DataFrame, key: str, block_bytes: Column) -> DataFrame:
    """Per sidecar: at most 16 levels, halvings of whole 4x4 blocks, packed offsets, exact total.

    ``mips`` is an array of at most a few levels, so every rule is an expression on the row.
    """
    mips = F.col("mips")
    sizes = F.transform(mips, lambda m: (m["w"] / 4) * (m["h"] / 4) * block_bytes)
    upto = F.transform(F.sequence(F.lit(0), F.size(mips)), lambda i: F.aggregate(
        F.slice(sizes, F.lit(1), i), F.lit(0.0), lambda s, v: s + v))
    placed = F.forall(F.transform(mips, lambda m, i: (
        (m["w"] == T.ancestor("width", i)) & (m["h"] == T.ancestor("height", i))
        & (m["w"] % 4 == 0) & (m["h"] % 4 == 0) & (m["offset"] == F.get(upto, i)))), lambda ok: ok)
    good = (F.size(mips).between(1, T.MAX_MIPS)) & placed & (F.element_at(upto, -1) == F.col("payload_bytes"))
    return sidecars.select(key, F.coalesce(good, F.lit(False)).alias("ok"))


def missing_channels(layers: DataFrame, by: list[str]) -> DataFrame:
    """Required channels that a bundle lacks: anti-join with the fixed channel list."""
    required = F.array(*[F.lit(c) for c in T.CHANNEL_FORMATS])
    bundles = layers.select(*by).distinct().withColumn("channel", F.explode(required))
    return bundles.join(layers.select(*by, "channel").distinct(), [*by, "channel"], "left_anti")


def resolve_tiles(requests: DataFrame, resident: DataFrame, max_mip: int) -> DataFrame:
    """Each requested key with its finest resident ancestor, and how many levels up it is.

    Requests are reduced to their keys, a key expands to its ancestors (at most the level count), and
    the match is an equality join.
    """
    keys = requests.select(*T.KEY).distinct()
    up = keys.withColumn("levels_up", F.explode(F.sequence(F.lit(0), F.lit(max_mip) - F.col("mip"))))
    cand = up.select(*T.KEY, "levels_up", (F.col("mip") + F.col("levels_up")).alias("r_mip"),
                     T.ancestor("y", "levels_up").alias("r_y"), T.ancestor("x", "levels_up").alias("r_x"))
    have = resident.select("layer", F.col("mip").alias("r_mip"), F.col("y").alias("r_y"), F.col("x").alias("r_x")).distinct()
    hits = cand.join(have, ["layer", "r_mip", "r_y", "r_x"])
    best = hits.groupBy(*T.KEY).agg(F.min_by(F.struct("levels_up", "r_mip", "r_y", "r_x"), "levels_up").alias("b"))
    return best.select(*T.KEY, "b.*")
