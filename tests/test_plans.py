"""Compositions: relations that must hold, and the orbit model's published vectors."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import adapters as A
from gridspark.operators import asof
from gridspark.plans import aurora, bake, clouds, composites, convection, model, quality
from gridspark.sources import message_index
from gridspark.udf import sql_functions
from test_operators import grid_frame, to_array


FOLDER = "/root/testdata/sf0.001"


def storm_case(spark, missing=False):
    h, w = 40, 60
    packed = {"cloud": np.full((h, w), 20.0), "cape": np.zeros((h, w)), "rain": np.full((h, w), 100.0)}
    packed["cape"][10:20, 10:20] = 60
    conv = np.zeros((h, w))
    conv[14, 13] = conv[35, 50] = 1.0
    frame = grid_frame(spark, packed["cloud"], "cloud")
    for n in ("cape", "rain"):
        frame = frame.join(grid_frame(spark, packed[n], n), ["grid_id", "y", "x"])
    frame = frame.select("grid_id", "y", "x", *[F.col(c).cast("int").alias(c) for c in packed])
    conv = grid_frame(spark, conv, "conv")
    if missing:
        conv = conv.withColumn("conv", F.lit(None).cast("double"))
    return frame, convection.steer_storms(frame, conv, h, w), conv, (h, w)


def test_storms_move_to_the_cold_tops(spark):
    frame, steered, conv, (h, w) = storm_case(spark)
    cloud, rain = to_array(steered, h, w, "cloud"), to_array(steered, h, w, "rain")
    assert cloud[14, 13] >= 204 and rain[14, 13] >= 127.5
    assert cloud[35, 50] == 20          # no unstable air near
    assert rain[30, 5] == 25            # no top near: a quarter is kept
    assert rain[16, 15] == 100          # a top near: all is kept
    again = convection.steer_storms(frame, conv, h, w)
    assert (to_array(again, h, w, "rain") == rain).all()


def test_missing_convection_changes_nothing(spark):
    frame, steered, _, (h, w) = storm_case(spark, missing=True)
    for band in ("cloud", "cape", "rain"):
        assert (to_array(steered, h, w, band) == to_array(frame, h, w, band)).all()


def test_only_tropical_anvils_count(spark):
    h, w = 64, 128
    ir, cold = np.full((h, w), 100.0), np.full((h, w), 60.0)
    ir[30:34, 60:64] = ir[2:6, 60:64] = 220.0
    sky = grid_frame(spark, ir, "ir").join(grid_frame(spark, cold, "ir_cold"), ["grid_id", "y", "x"])
    conv = to_array(convection.deep_convection(sky, h, w, (32, 64)), 32, 64, "conv")
    assert conv[15, 30] > 0.5 and conv[1:3].max() == 0.0


def sky_frame(spark, h, w, **fields):
    base = None
    for name, a in fields.items():
        f = grid_frame(spark, np.asarray(a, float), name)
        base = f if base is None else base.join(f, ["grid_id", "y", "x"])
    return base


def test_missing_segment_falls_back_to_the_model(spark):
    h, w = 36, 72
    full = np.ones((h, w))
    ir = 80.0 * full
    ir[:, 40:] = np.nan
    sky = sky_frame(spark, h, w, albedo=np.nan * full, vis_clear=np.nan * full, ir=ir, ir_day=75.0 * full, ir_night=78.0 * full, cosine=0.0 * full)
    m = sky_frame(spark, h, w, model=0.6 * full, low=0.0 * full)
    out = clouds.cloud_cover(sky, m, h, w)
    cover, cold = to_array(out, h, w, "cover"), to_array(out, h, w, "coldness")
    assert cover[18, 60] == pytest.approx(0.6) and cold[18, 60] == pytest.approx(0.18)
    assert cover[0, 5] == pytest.approx(0.6)   # beyond the mosaic


def test_composites_relax_and_darken(spark):
    hour = 3_600_000_000
    rows = [(0, 0.5, 100.0, True, 0.0), (10, 0.9, 120.0, True, 10.0), (200, 0.9, 150.0, True, 82.0), (201, 0.2, 90.0, False, 83.0)]
    df = spark.createDataFrame([(r[0] * hour, 0, 0, *r[1:]) for r in rows], "run_us bigint, y int, x int, albedo double, ir double, is_day boolean, u double")
    out = [(r.vis_clear, r.ir_day, r.ir_night) for r in composites.composites(df).orderBy("run_us").collect()]
    assert out[0] == (pytest.approx(0.5), pytest.approx(100.0), None)
    assert out[1] == (pytest.approx(0.54), pytest.approx(106.0), None)
    assert out[2][0] == pytest.approx(min(0.54 + 0.004 * 72, 0.9)) and out[2][1] == pytest.approx(min(106 + 43.2, 150))
    assert out[3][0] == pytest.approx(0.2) and out[3][2] == pytest.approx(90.0)
    clock = composites.update_clock(df.select("run_us")).orderBy("run_us").collect()
    assert [r.u for r in clock] == [0.0, 10.0, 82.0, 83.0]


def test_state_update_equals_the_scan(spark):
    state = spark.createDataFrame([(0, 0, 0.5, 100.0, None)], "y int, x int, vis double, ir_day double, ir_night double")
    new = spark.createDataFrame([(0, 0, 0.9, 120.0, True), (0, 1, 0.3, 80.0, False)], "y int, x int, albedo double, ir double, is_day boolean")
    out = {r.x: (r.vis, r.ir_day, r.ir_night) for r in composites.update_state(state, new, 10.0).collect()}
    assert out[0] == (pytest.approx(0.54), pytest.approx(106.0), None) and out[1] == (0.3, None, 80.0)


def test_retained_observation(spark):
    hour = 3_600_000_000
    cols = "record string, packing_version int, clouds_us bigint, now_us bigint, name string, sha256 string, bytes bigint"
    rec = spark.createDataFrame([("kept", 4, 0, 5 * hour, "a", "h", 4), ("old", 4, 0, 6 * hour, "a", "h", 4), ("version", 3, 0, hour, "a", "h", 4),
                                 ("changed", 4, 0, hour, "b", "h", 4), ("gone", 4, 0, hour, "c", "h", 4), ("bare", 4, 0, hour, "d", "h", 4)], cols)
    files = spark.createDataFrame([("a", "h", 4), ("a.json", "", 1), ("b", "x", 4), ("b.json", "", 1), ("d", "h", 4)], "name string, sha256 string, bytes bigint")
    out = model.retained_observation(rec, files).collect()
    assert [(r.record, r.clouds_us) for r in out] == [("kept", 0)]


def test_flash_counts(spark):
    rows = [(0, f, 0, x, 200 if (f, x) == (1, 2) else 10) for f in range(3) for x in range(4)]
    out = quality.flash_counts(spark.createDataFrame(rows, "grid_id int, frame int, y int, x int, r int"), ["grid_id"], "frame", ["r"], 20)
    assert {r.frame: r.flashes for r in out.collect()} == {0: 0, 1: 1, 2: 0}


def test_sql_surface(spark):
    sql_functions.register(spark)
    row = spark.sql("select grid_smoothstep(0D, 1D, 0.25D) as s, grid_smoothstep(0D, 1D, null) as n, tile_parent(7) as p, grid_row_lat(0, 180) as lat").collect()[0]
    assert row.s == pytest.approx(0.15625) and row.n is None and row.p == 3 and row.lat == 89.5
    lines = spark.createDataFrame([(7, 2, "3:250:d:C:l:anl:"), (7, 0, "1:0:d:A:l:anl:"), (8, 0, "1:5:d:Z:l:anl:"), (7, 1, ""), (7, 1, "2:100:d:B:l:anl:")],
                                  "file_id int, line_no int, text string")
    out = spark.sql("select * from index_ranges(table(select * from {lines}))", lines=lines).collect()
    assert sorted((r.file_id, r.line_no, r.name, r.start_byte, r.end_byte) for r in out) == [(7, 1, "A", 0, 99), (7, 2, "B", 100, 249)]


def test_packed_index_lines(spark):
    sql_functions.register(spark)
    rows = [(f, i, f"{i}:{100 * i}:d:N{i % 3}:l:anl:" if i != 4 else "") for f in (3, 5) for i in range(7)] + [(9, 0, "0:0:d:Z:l:anl:"), (9, 1, None)]
    lines = spark.createDataFrame(rows, "file_id int, line_no int, text string")
    packed = message_index.packed_lines(lines, 3)
    assert packed.count() == 7
    one, many = (sorted(map(tuple, spark.sql("select * from index_ranges(table(select * from {lines}))", lines=df).collect())) for df in (lines, packed))
    assert one == many and len(many) == 10 and many[0] == (3, 1, "N0", 0, 99)


def test_index_lines_go_along_without_their_text(spark):
    lines = spark.createDataFrame([(1, 0, "0:0:d:A"), (1, 1, "1:50:d:B")], "file_id int, line_no int, text string")
    out = message_index._with_end(lines, {"name": F.col("f")[3]})
    assert out.columns == ["file_id", "line_no", "start_byte", "name", "end_byte"] and tuple(out.first()) == (1, 0, 0, "A", 49)


def test_long_hashes_take_whole_payloads(spark):
    payloads = [b"", b"a", "É\0".encode() * 50, None, bytes(range(256)) * 40]

    def fnv(data):
        h = 2166136261
        for byte in data:
            h = (h ^ byte) * 16777619 % 2 ** 32
        return h
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p binary").coalesce(1)
    got = {r.i: r.h for r in df.select("i", sql_functions.fnv1a32_large("p").alias("h")).collect()}
    assert got == {i: None if p is None else fnv(p) for i, p in enumerate(payloads)}


def test_aurora_nodes_that_are_missing_count_as_zero(spark):
    rng = np.random.default_rng(2)
    nodes = [(0, int(lon), int(lat), float(rng.integers(0, 101))) for lon in range(24) for lat in range(-5, 7)]
    holes = [(g, lon, lat, None if (lon + lat) % 5 == 0 else v) for g, lon, lat, v in nodes]
    zeros = [(g, lon, lat, v or 0.0) for g, lon, lat, v in holes]
    made = [{(r.y, r.x): r.alpha for r in aurora.aurora_grid(spark.createDataFrame(rows, "k int, lon int, lat int, value double"), "k", (13, 24), (26, 48)).collect()}
            for rows in (holes, [h for h in holes if h[3] is not None], zeros)]
    assert made[0] == made[1] == made[2] and len(made[0]) == 26 * 48 and sum(made[0].values()) > 0


def test_synthetic_values_replace_only_what_they_cover(spark):
    now = spark.createDataFrame([(0, 0, x, 5, 9) for x in range(3)], "grid_id int, y int, x int, r int, a int")
    oval = spark.createDataFrame([(0, 0, 1, 200)], "grid_id int, y int, x int, p int")
    out = {r.x: (r.a, r.source) for r in model.synthetic_override(now, oval, "a", "storm").collect()}
    assert out == {0: (9, None), 1: (200, "SYNTHETIC storm (not an observation)"), 2: (9, None)}


def test_frame_hashes_see_every_texel(spark):
    rows = [(f, y, x, 10 * y + x) for f in range(3) for y in range(3) for x in range(4)]
    rows[-1] = (2, 2, 3, 99)
    out = quality.frame_hashes(spark.createDataFrame(rows, "f int, y int, x int, r int"), ["f"], ["r"]).collect()
    by = {r.f: r.sha256 for r in out}
    lines = [hashlib.sha256(bytes(10 * y + x for x in range(4))).hexdigest() for y in range(3)]
    assert by[0] == by[1] == hashlib.sha256("".join(lines).encode()).hexdigest() and by[2] != by[0]


def test_hourly_frames_by_equality(spark):
    seen = [(i, t) for i, t in enumerate([0, 59, 60, 61, 179, 180, 200, 500])]
    frames = [(0, "a"), (60, "b"), (300, "c")]
    out = asof.latest_step(spark.createDataFrame(seen, "i int, t long"), spark.createDataFrame(frames, "f long, v string"), [], "t", "f", ["v"], 60, 120)
    want = {i: next(((v, f) for f, v in reversed(frames) if f <= t), (None, None)) for i, t in seen}
    want = {i: (v, f) if f is not None and dict(seen)[i] - f <= 120 else (None, None) for i, (v, f) in want.items()}
    assert {r.i: (r.v, r.matched_at) for r in out.collect()} == want


def test_clouds_stand_alone_where_the_model_fails(spark):
    sky = A.sky_cells(spark, FOLDER)
    full = sky.select("grid_id", "y", "x", F.col("model").alias("model"), F.col("low").alias("low"))
    some = full.where("x >= 20").withColumn("low", F.when(F.col("x") >= 40, F.col("low")))
    cover = lambda m: {(r.y, r.x): (r.cover, r.missing) for r in clouds.cloud_cover(sky.drop("model", "low"), m, A.H, A.W).where("y < 40 and x < 60").collect()}
    whole, part = cover(full), cover(some)
    assert part.keys() == whole.keys()
    assert all((part[k][0] is None) == (k[1] < 20 and part[k][1]) for k in part)
    assert all(part[k] == whole[k] for k in part if k[1] >= 40)


@pytest.mark.parametrize("h,w,tile,gutter", [(5, 7, 4, 1), (9, 8, 4, 2), (1, 1, 4, 1), (3, 2, 8, 3)])
def test_tiles_are_cut_from_block_rows_slice_by_slice(spark, h, w, tile, gutter):
    rng = np.random.default_rng(h)
    sizes = {1: 8, 2: 16}
    maps = {(layer, y): rng.integers(0, 256, w * n, dtype=np.uint8).tobytes() for layer, n in sizes.items() for y in range(h)}
    rows = [(0, layer, 3, y, w, h, sizes[layer], bytearray(p)) for (layer, y), p in maps.items()]
    df = spark.createDataFrame(rows, "grid_id int, layer int, mip int, y int, w int, h int, block_bytes int, payload binary")
    got = {(r.layer, r.ty, r.tx): (bytes(r.payload), r.content_hash) for r in bake.retile_blocks(df, tile, gutter).collect()}
    want = {}
    for layer, n in sizes.items():
        for ty in range(-(-h // tile)):
            for tx in range(-(-w // tile)):
                out = b""
                for ly in range(tile + 2 * gutter):
                    row = maps[layer, min(h - 1, max(0, ty * tile + ly - gutter))]
                    for lx in range(tile + 2 * gutter):
                        x = (tx * tile + lx - gutter) % w
                        out += row[x * n:(x + 1) * n]
                want[layer, ty, tx] = (out, hashlib.sha256(out).hexdigest())
    assert got == want
