"""Scalar functions against closed forms and typed-in values."""

import math

import pytest
from pyspark.sql import functions as F

from gridspark.functions import colour, geo, numeric as N, oval, physics, sky, solar, stars as S, text, tiles as T, timefn


def one(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]
    return list(row) if len(cols) > 1 else row[0]


def test_clip_keeps_missing_and_steps_fall(spark):
    null = F.lit(None).cast("double")
    assert one(spark, N.clip(null, 0.0, 1.0)) is None
    assert one(spark, N.smoothstep(0.0, 1.0, null)) is None
    up, down = one(spark, N.smoothstep(0.0, 1.0, F.lit(0.25)), N.smoothstep(1.0, 0.0, F.lit(0.25)))
    assert up == pytest.approx(0.15625) and down == pytest.approx(1 - 0.15625)


def test_three_rounding_rules(spark):
    even, up, away, neg = one(spark, F.rint(F.lit(2.5)), N.half_up_255(F.lit(0.5)), N.half_away(F.lit(2.5)), N.half_away(F.lit(-2.5)))
    assert (even, up, away, neg) == (2.0, 128, 3, -3)
    assert one(spark, N.rint255(F.lit(0.5))) == 128


def test_black_and_white_average_in_linear_light(spark):
    mean = (colour.srgb_to_linear(F.lit(0)) + colour.srgb_to_linear(F.lit(255))) / 2
    assert 185 <= one(spark, N.rint255(colour.linear_to_srgb(mean))) <= 190


@pytest.mark.parametrize("lat,lon0,ts", [(90.0, -45.0, 70.0), (70.0, -45.0, 70.0), (-70.0, 0.0, -70.0)])
def test_polar_stereographic_closed_form(spark, lat, lon0, ts):
    a, b = 6378.273, 6356.889449
    px, py = geo.polar_stereographic(F.lit(lat), F.lit(lon0), a_km=a, b_km=b, lat_ts=ts, lon_0=lon0, north=lat > 0)
    x, y = one(spark, px, py)
    e2 = 1 - (b / a) ** 2
    radius = 0.0 if lat == 90.0 else a * math.cos(math.radians(abs(lat))) / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)
    assert x == pytest.approx(0.0, abs=1e-6)
    assert y == pytest.approx(-radius if lat > 0 else radius, abs=1e-6)


def test_projection_text(spark):
    m = one(spark, geo.parse_proj(F.lit("+proj=stere +a=6378273 +b=6356889.449 +lat_0=-90 +lon_0=0")))
    assert m["a"] == 6378273 and m["b"] == 6356889.449 and m["lat_0"] == -90


def test_geocentric_latitude(spark):
    low, high, equator = one(spark, *[geo.geocentric_lat(F.lit(a), F.lit(h)) for a, h in ((45.0, 0.0), (45.0, 400.0), (0.0, 400.0))])
    assert low == pytest.approx(44.80758, abs=1e-4)
    assert low < high < 45.0 and equator == 0.0


def test_solar_terms_near_solstice_and_noon(spark):
    t = F.lit(1_718_971_200_000_000)  # 2024-06-21 12:00
    dec, noon, night = one(spark, F.degrees(solar.declination(t)), solar.zenith_cosine(t, F.lit(23.44), F.lit(0.5)),
                           solar.zenith_cosine(t, F.lit(23.44), F.lit(180.0)))
    assert dec == pytest.approx(23.44, abs=0.05) and noon > 0.999 and night < -0.6


def test_eclipse_limits(spark):
    apart, total, annular, half = one(spark, sky.visible_fraction(F.lit(1.0), F.lit(1.0), F.lit(2.5)),
                                      sky.visible_fraction(F.lit(1.0), F.lit(1.1), F.lit(0.0)),
                                      sky.visible_fraction(F.lit(1.0), F.lit(0.5), F.lit(0.1)),
                                      sky.visible_fraction(F.lit(1.0), F.lit(1.0), F.lit(1e-9)))
    assert apart == 1.0 and total == 0.0 and annular == pytest.approx(0.75) and half == pytest.approx(0.0, abs=1e-6)


def test_element_checksum_and_epoch(spark):
    line = "1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927"
    ok, broken, epoch = one(spark, text.element_line_ok(F.lit(line)), text.element_line_ok(F.lit(line.replace("264", "265"))),
                            timefn.element_epoch(F.lit(line)))
    assert ok and not broken
    assert epoch == (1_221_868_800 + round(0.51782528 * 86400)) * 1_000_000


def test_fnv1a_known_values(spark):
    assert one(spark, *[text.fnv1a32(F.lit(s)) for s in ("", "a", "foobar")]) == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


def test_age_labels(spark):
    now = F.lit(100 * timefn.HOUR_US)
    labels = one(spark, *[timefn.age_label(now - h, now) for h in (6 * timefn.HOUR_US, 19 * timefn.HOUR_US, -10_000 * 1_000_000)])
    assert labels == ["current", "stale", "future"]


def test_names(spark):
    assert one(spark, text.safe_name(F.lit("a/b c")), text.safe_name(F.lit("")), text.confined(F.lit("../x")), text.confined(F.lit("x"))) == [
        "a_b_c", "output", False, True]


def test_key_values_keep_the_last(spark):
    assert one(spark, text.key_values(F.lit("a=1 noise b=2 a=3"))) == {"a": "3", "b": "2"}
    assert one(spark, text.key_values(F.lit("a=1 b=2"))) == {"a": "1", "b": "2"}


def test_tile_algebra(spark):
    w, count, tiles, parent = one(spark, T.mip_size(F.lit(1001), F.lit(2)), T.full_mip_count(F.lit(2048), F.lit(1024)),
                                  T.pyramid_tiles(F.lit(2048), F.lit(1024), F.lit(12)), T.ancestor(F.lit(13), F.lit(2)))
    assert (w, count, parent) == (251, 12, 3)
    assert tiles == 8 * 4 + 4 * 2 + 2 * 1 + 9


def test_feedback_coordinates(spark):
    east, west, near, one_axis, both = one(
        spark, T.uv_tile_wrapped(F.lit(1.0), F.lit(8)), T.uv_tile_wrapped(F.lit(0.0), F.lit(8)),
        geo.wrapped_distance(F.lit(0.998), F.lit(0.002)),
        T.footprint_mip(F.lit(1.0 / 256), F.lit(0.0), F.lit(0.0), F.lit(1.0 / 256), F.lit(256), F.lit(256), F.lit(5)),
        T.footprint_mip(F.lit(3.0 / 256), F.lit(0.0), F.lit(0.0), F.lit(3.0 / 256), F.lit(256), F.lit(256), F.lit(5)))
    assert (east, west, one_axis, both) == (7, 0, 0, 1) and near == pytest.approx(0.004)


def test_star_codes_round_trip(spark):
    df = spark.createDataFrame([(101.2872, -16.7161, -1.44, 0.009, -546.01, -1223.08), (0.0, 90.0, 8.0, 2.5, 0.0, 0.0)],
                               "ra double, dec_deg double, vmag double, bv double, pm_ra double, pm_dec double")
    coded = df.select("*", *[c.alias(n) for n, c in S.encode().items()])
    words = coded.select(*[F.col(c).alias("in_" + c) for c in df.columns], *[c.alias(n) for n, c in S.pack_words().items()])
    codes = words.select("*", *[c.alias(n) for n, c in S.unpack_words().items()])
    for row in codes.select("*", *[c.alias(n) for n, c in S.decode().items()]).collect():
        assert abs(row.ra - row.in_ra) < 1e-4 and abs(row.dec_deg - row.in_dec_deg) < 1e-4
        assert abs(row.vmag - row.in_vmag) < 0.03 and abs(row.pm_ra - row.in_pm_ra) < 0.2 and abs(row.pm_dec - row.in_pm_dec) < 0.2


def test_optical_depth_rules(spark):
    dust, floor = one(spark, physics.angstrom(F.lit(0.5), F.lit(0.5)), physics.angstrom(F.lit(0.0), F.lit(0.0)))
    assert dust == pytest.approx(0.0) and floor == pytest.approx(0.0)
    assert one(spark, physics.rain_rate(physics.rain_fraction(F.lit(0.002)))) == pytest.approx(0.002)


def test_storm_oval_at_midnight(spark):
    height, width = 180, 360
    cells = spark.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    times = oval.with_time_terms(spark.createDataFrame([(1_790_553_600_000_000,)], "t_us bigint"), "t_us")  # 2026-09-28
    grid = cells.join(F.broadcast(times)).select("y", "x", oval.probability_byte(geo.row_lat("y", height), geo.col_lon("x", width), "noon", "east", 7.0).alias("p"))
    rows = {(r.y, r.x): r.p for r in grid.collect()}
    lat = lambda y: 90 - (y + 0.5)
    assert all(p == 0 for (y, _), p in rows.items() if abs(lat(y)) < 35)
    assert max(p for (y, _), p in rows.items() if lat(y) < 0) > 0.4 * 255
    column = lambda x: max(p for (y, xx), p in rows.items() if xx == x and lat(y) > 0)
    best = max(range(width), key=column)
    assert column(best) > 2 * column((best + 180) % width)
