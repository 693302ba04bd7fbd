"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import colour, geo, numeric as N, oval, physics, sky, solar, stars as S, text, tiles as T, timefn
from .registry import query
from .views import BYTES, CELLS, OBS, REQ, SKY, STARS, TEL, clip, cosz, linear, r6, solar as solar_sql, srgb, step, with_


@query("h1_smoothsteps", with_(SKY) + f"""select grid_id, y, x, {r6(step('0.02e0', '0.45e0', 'albedo'))} as rising,
  {r6(step('72.7e0', '70.5e0', 'abs(90e0 - (y + 0.5e0) * 1.125e0)'))} as falling from sky""")
def h1(spark, d):
    return A.sky_cells(spark, d).select("grid_id", "y", "x", N.r6(N.smoothstep(0.02, 0.45, "albedo")).alias("rising"),
                                        N.r6(N.smoothstep(72.7, 70.5, F.abs(geo.row_lat("y", A.H)))).alias("falling"))


@query("h2_transfer_curves", with_(BYTES) + f"""select grid_id, y, x, {r6(linear('r'))} as linear, round_even({srgb('(g / 255e0)')} * 255e0, 0)::int as coded,
  {r6('0.2126e0 * ' + linear('r') + ' + 0.7152e0 * ' + linear('g') + ' + 0.0722e0 * ' + linear('b'))} as luma from bytes""")
def h2(spark, d):
    lin = [colour.srgb_to_linear(c) for c in "rgb"]
    return A.byte_cells(spark, d).select(
        "grid_id", "y", "x", N.r6(lin[0]).alias("linear"), N.rint255(colour.linear_to_srgb(F.col("g") / 255.0)).alias("coded"),
        N.r6(colour.luminance(*lin)).alias("luma"))


@query("h3_quantised_fields", with_(SKY) + f"""select grid_id, y, x,
  round_even({clip('ln(1 + 3600e0 * greatest(low / 100, 0e0)) / ln(51e0)', '0e0', '1e0')} * 255e0, 0)::int as rain,
  round_even({clip('model', '0e0', '1e0')} * 255e0, 0)::int as cape,
  {r6(clip('model', '0e0', '1e0') + ' * (1 - exp(-75e0 * greatest(low / 20, 0e0)))')} as cloud,
  {r6('(low * 2 + 0.5e0) / 3e0')} as alpha, {r6('sqrt(greatest(0e0, model) / 4e0)')} as depth from sky""")
def h3(spark, d):
    s = A.sky_cells(spark, d)
    return s.select(
        "grid_id", "y", "x", N.rint255(physics.rain_fraction(F.col("low") / 100)).alias("rain"),
        N.rint255(physics.cape_fraction(F.col("model") * 4000.0)).alias("cape"),
        N.r6(physics.cloud_fraction(F.col("model") * 100.0, F.col("low") / 20)).alias("cloud"),
        N.r6(physics.angstrom_fraction(F.col("low") * 2)).alias("alpha"),
        N.r6(physics.depth_fraction(F.greatest(F.lit(0.0), F.col("model")))).alias("depth"))


@query("h4_angstrom", with_(SKY) + """select grid_id, y, x, round(greatest(-0.5e0, least(2.5e0, -ln(greatest(model, 1e-4) / greatest(low, 1e-4)) / ln(440e0 / 645e0))), 6) + 0e0 as alpha,
  round(greatest(0e0, least(4e0, model * 6 - 1)), 6) + 0e0 as tau from sky""")
def h4(spark, d):
    return A.sky_cells(spark, d).select("grid_id", "y", "x", N.r6(physics.angstrom("model", "low")).alias("alpha"),
                                        N.r6(physics.optical_depth(F.col("model") * 6 - 1)).alias("tau"))


@query("h5_pixel_geometry", with_(CELLS) + """, p as (select grid_id, y, x, 90e0 - (y + 0.5e0) * 1.125e0 as lat, -180e0 + (x + 0.5e0) * 1.8e0 as lon from cells)
select *, greatest(0, least(79, floor((90e0 - lat) * (80 / 180e0))))::int as y2, (floor((lon + 540e0) * (100 / 360e0))::int % 100)::int as x2 from p""")
def h5(spark, d):
    p = A.cells(spark, d).select("grid_id", "y", "x", geo.row_lat("y", A.H).alias("lat"), geo.col_lon("x", A.W).alias("lon"))
    return p.select("*", geo.lat_row("lat", 80).alias("y2"), geo.lon_col(F.col("lon") + 360.0, 100).alias("x2"))


@query("h6_solar_terms", with_(OBS) + f"""select event_id, {r6(solar_sql('t_us')['dec'])} as declination, {r6(solar_sql('t_us')['dec2'])} as coarse,
  {r6(solar_sql('t_us')['eqt'])} as equation, {r6(cosz('t_us', 'lat', 'lon'))} as cosine from obs""")
def h6(spark, d):
    return A.observations(spark, d).select(
        "event_id", N.r6(solar.declination("t_us")).alias("declination"), N.r6(solar.declination("t_us", 2)).alias("coarse"),
        N.r6(solar.equation_of_time("t_us")).alias("equation"), N.r6(solar.zenith_cosine("t_us", "lat", "lon")).alias("cosine"))


@query("h7_polar_stereographic", f"""with p as (
  select event_id, case when event_id % 2 = 0 then 1e0 else -1e0 end as s, (36e0 + (event_id * 7 % 530) / 10e0) as alat, (event_id * 13 % 3600) / 10e0 - 180e0 as lon from events),
t as (select *, radians(alat) as phi, radians(lon - case when s > 0 then -45e0 else 0e0 end) * s as lam, sqrt(1e0 - pow(6356.889449e0 / 6378.273e0, 2e0)) as e from p),
k as (select *, 6378.273e0 * (cos(radians(70e0)) / sqrt(1e0 - e * e * sin(radians(70e0)) * sin(radians(70e0))))
   * (tan(pi() / 4 - phi / 2) / pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2))
   / (tan(pi() / 4 - radians(70e0) / 2) / pow((1 - e * sin(radians(70e0))) / (1 + e * sin(radians(70e0))), e / 2)) as rho from t)
select event_id, round(s * rho * sin(lam), 5) + 0e0 as px, round(-s * rho * cos(lam), 5) + 0e0 as py from k""")
def h7(spark, d):
    proj = "case when event_id % 2 = 0 then '+proj=stere +a=6378273 +b=6356889.449 +lat_0=90 +lat_ts=70 +lon_0=-45' else '+proj=stere +a=6378273 +b=6356889.449 +lat_0=-90 +lat_ts=-70 +lon_0=0' end"
    p = A.table(spark, d, "events").selectExpr(
        "event_id", f"{proj} as proj", "case when event_id % 2 = 0 then 1 else -1 end * (36e0 + (event_id * 7 % 530) / 10e0) as lat",
        "(event_id * 13 % 3600) / 10e0 - 180e0 as lon").withColumn("m", geo.parse_proj("proj"))
    m = F.col("m")
    px, py = geo.polar_stereographic("lat", "lon", a_km=m["a"] / 1000.0, b_km=m["b"] / 1000.0, lat_ts=m["lat_ts"],
                                     lon_0=m["lon_0"], north=m["lat_0"] > 0)
    return p.select("event_id", (F.round(px, 5) + 0.0).alias("px"), (F.round(py, 5) + 0.0).alias("py"))


@query("h8_great_circle", """with p as (select event_id, radians((user_id % 150) - 75e0) as la, radians(value % 360e0 - 180e0) as lo, radians(event_id % 360) as b, radians(1e0 + event_id % 30) as d from events),
e as (select *, asin(sin(la) * cos(d) + cos(la) * sin(d) * cos(b)) as la2 from p),
f as (select *, lo + atan2(sin(b) * sin(d) * cos(la), cos(d) - sin(la) * sin(la2)) as lo2 from e)
select event_id, round(degrees(la2), 6) + 0e0 as lat, round(degrees(lo2), 6) + 0e0 as lon,
  round(cos(atan2(sin(lo - lo2) * cos(la), cos(la2) * sin(la) - sin(la2) * cos(la) * cos(lo - lo2))), 6) + 0e0 as back from f""")
def h8(spark, d):
    p = A.table(spark, d, "events").selectExpr("event_id", "radians((user_id % 150) - 75e0) as la", "radians(value % 360e0 - 180e0) as lo",
                                               "radians(event_id % 360) as b", "radians(1e0 + event_id % 30) as d")
    la, lo, back = geo.destination(F.col("la"), F.col("lo"), F.col("b"), F.col("d"))
    return p.select("event_id", N.r6(F.degrees(la)).alias("lat"), N.r6(F.degrees(lo)).alias("lon"), N.r6(F.cos(back)).alias("back"))


@query("h9_geodesy", """with p as (select event_id, (user_id % 150) * 1.2e0 - 89e0 as lat, value % 360e0 - 180e0 as lon, event_id % 900 + 1e0 as alt from events),
q as (select *, (1 / 298.26e0) * (2 - 1 / 298.26e0) as e2 from p), n as (select *, 6378.135e0 / sqrt(1 - e2 * sin(radians(lat)) * sin(radians(lat))) as n from q)
select event_id, round(degrees(atan2((n * (1 - e2) + alt) * sin(radians(lat)), (n + alt) * cos(radians(lat)))), 6) + 0e0 as geocentric,
  round(cos(radians(lat)) * cos(radians(lon)), 6) + 0e0 as ux, round(-cos(radians(lat)) * sin(radians(lon)), 6) + 0e0 as sy, round(degrees(acos(6371e0 / (6371e0 + alt))), 6) + 0e0 as dip from n""")
def h9(spark, d):
    p = A.table(spark, d, "events").selectExpr("event_id", "(user_id % 150) * 1.2e0 - 89e0 as lat", "value % 360e0 - 180e0 as lon", "event_id % 900 + 1e0 as alt")
    return p.select("event_id", N.r6(geo.geocentric_lat("lat", "alt")).alias("geocentric"), N.r6(geo.unit_vector("lat", "lon")[0]).alias("ux"),
                    N.r6(geo.scene_vector("lat", "lon")[1]).alias("sy"), N.r6(geo.horizon_dip("alt")).alias("dip"))


@query("h10_element_epochs", """with l as (select event_id, (event_id * 37 % 100)::int as yy, (event_id * 11 % 370) as dd, event_id % 1000 as f from events)
select event_id, case when dd between 1 and 366 then (date_diff('day', date '1970-01-01', make_date(case when yy >= 57 then 1900 + yy else 2000 + yy end, 1, 1)) * 86400
  + floor((dd - 1 + f / 1000e0) * 86400e0 + 0.5e0)::bigint) * 1000000 end as epoch_us from l""")
def h10(spark, d):
    lines = A.table(spark, d, "events").selectExpr("event_id", """concat(rpad('1 25544U 98067A', 18, ' '), lpad(cast(event_id * 37 % 100 as string), 2, '0'),
        lpad(cast(event_id * 11 % 370 as string), 3, '0'), '.', lpad(cast(event_id % 1000 as string), 3, '0'), '00000  .00') as line""")
    return lines.select("event_id", timefn.element_epoch("line").alias("epoch_us"))


@query("h11_ages", with_(OBS) + """, a as (select event_id, t_us as now_us, (t_us + (event_id % 50 - 45)::bigint * 3600000000)::bigint as valid from obs)
select event_id, case when now_us - valid < -3600000000 then 'future' when now_us - valid > 64800000000 then 'stale' else 'current' end as label,
  abs(now_us - valid) < 21600000000 as clouds, abs(now_us - valid) < 86400000000 as aerosol, abs(now_us - valid) < 345600000000 as ice from a""")
def h11(spark, d):
    a = A.observations(spark, d).withColumn("valid", F.col("t_us") + (F.col("event_id") % 50 - 45) * timefn.HOUR_US)
    return a.select("event_id", timefn.age_label("valid", "t_us").alias("label"), timefn.usable("valid", "t_us", 6).alias("clouds"),
                    timefn.usable("valid", "t_us", 24).alias("aerosol"), timefn.usable("valid", "t_us", 96).alias("ice"))


@query("h12_tile_algebra", """with k as (select o_orderkey as k, 300 + o_orderkey % 7000 as w, 200 + o_orderkey % 3000 as h, (o_orderkey % 5)::int as mip, (o_orderkey * 7 % 99)::int as x from orders),
l as (select k, unnest(range(13)) as m, w, h from k),
t as (select k, sum(case when m < 9 then ceil(ceil(w / pow(2e0, m)) / 256e0) * ceil(ceil(h / pow(2e0, m)) / 256e0) else 0 end)::bigint as nine from l group by 1)
select k, greatest(1, ceil(w / pow(2e0, mip)))::bigint as mip_w, ceil(greatest(1, ceil(w / pow(2e0, mip))) / 256e0)::bigint as tiles_x,
  (ceil(log2(greatest(w, h))) + 1)::int as levels, nine, (x >> 1)::int as parent, (x >> 3)::int as third from k join t using (k)""")
def h12(spark, d):
    k = A.table(spark, d, "orders").selectExpr("o_orderkey as k", "300 + o_orderkey % 7000 as w", "200 + o_orderkey % 3000 as h",
                                               "cast(o_orderkey % 5 as int) as mip", "cast(o_orderkey * 7 % 99 as int) as x")
    return k.select("k", T.mip_size("w", "mip").cast("bigint").alias("mip_w"), T.tiles_across("w", "mip").cast("bigint").alias("tiles_x"),
                    T.full_mip_count("w", "h").alias("levels"), T.pyramid_tiles("w", "h", F.lit(9)).alias("nine"),
                    T.ancestor("x", F.lit(1)).alias("parent"), T.ancestor("x", F.lit(3)).alias("third"))


@query("h13_feedback_tiles", """with p as (select event_id, (event_id % 1001) / 1000e0 as u, (user_id % 101) / 100e0 as v, value / 1e5 as du, value / 3e5 as dv from events)
select event_id, (floor(greatest(0e0, least(1 - pow(2e0, -23), u)) * 8)::int % 8)::int as tx, floor(greatest(0e0, least(1 - pow(2e0, -23), v)) * 4)::int as ty,
  least(5, greatest(0, floor(log2(greatest(1e0, sqrt(pow(du * 2048, 2e0) + pow(dv * 1024, 2e0)), sqrt(pow(dv * 2048, 2e0) + pow(du * 1024, 2e0)))) + 0.25e0)))::int as mip from p""")
def h13(spark, d):
    p = A.table(spark, d, "events").selectExpr("event_id", "(event_id % 1001) / 1000e0 as u", "(user_id % 101) / 100e0 as v", "value / 1e5D as du", "value / 3e5D as dv")
    return p.select("event_id", T.uv_tile_wrapped("u", F.lit(8)).alias("tx"), T.uv_tile_clamped("v", F.lit(4)).alias("ty"),
                    T.footprint_mip("du", "dv", "dv", "du", F.lit(2048), F.lit(1024), F.lit(6), bias=0.25).alias("mip"))


@query("h14_wrapped_distance", """select event_id, round(least(abs(a - b), 1 - abs(a - b)), 6) + 0e0 as d from (
  select event_id, (event_id % 1000) / 1000e0 as a, (user_id % 97) / 97e0 as b from events) q""")
def h14(spark, d):
    p = A.table(spark, d, "events").selectExpr("event_id", "(event_id % 1000) / 1000e0 as a", "(user_id % 97) / 97e0 as b")
    return p.select("event_id", N.r6(geo.wrapped_distance("a", "b")).alias("d"))


CODES = """codes as (select star_id, least(round((ra % 360e0) / 360e0 * 16777216e0), 16777215)::int as ra_code,
  round(greatest(0e0, least(1e0, (dec_deg + 90e0) / 180e0)) * 16777215e0)::int as dec_code,
  (1 + round(greatest(0e0, least(1e0, (vmag + 2e0) / 10e0)) * 254e0))::int as mag_code, round(greatest(0e0, least(1e0, (bv + 0.5e0) / 3e0)) * 255e0)::int as bv_code,
  greatest(0, least(65535, round(pm_ra / 0.25e0) + 32768))::int as pm_ra_code, greatest(0, least(65535, round(pm_dec / 0.25e0) + 32768))::int as pm_dec_code from stars)"""


@query("h15_star_codes", with_(STARS, CODES) + """select star_id, ra_code::bigint * 256 + (dec_code >> 16) as word0, (dec_code & 65535)::bigint * 65536 + mag_code * 256 + bv_code as word1,
  pm_ra_code::bigint * 65536 + pm_dec_code as word2, round(ra_code / 16777216e0 * 360e0, 6) as ra, round(dec_code / 16777215e0 * 180e0 - 90e0, 6) + 0e0 as dec_deg,
  round(-2e0 + (mag_code - 1) / 254e0 * 10e0, 6) + 0e0 as vmag, (pm_ra_code - 32768) * 0.25e0 as pm_ra from codes""")
def h15(spark, d):
    coded = A.stars(spark, d).select("star_id", *[c.alias(n) for n, c in S.encode().items()])
    packed = coded.select("star_id", *[c.alias(n) for n, c in S.pack_words().items()])
    codes = packed.select("star_id", "word0", "word1", "word2", *[c.alias(n) for n, c in S.unpack_words().items()])
    out = S.decode()
    return codes.select("star_id", "word0", "word1", "word2", N.r6(out["ra"]).alias("ra"), N.r6(out["dec_deg"]).alias("dec_deg"),
                        N.r6(out["vmag"]).alias("vmag"), out["pm_ra"].alias("pm_ra"))


@query("h16_star_positions", with_(STARS) + """, q as (select star_id, radians(ra) as r, radians(dec_deg) as d, pm_ra * pi() / 648000000e0 * 26.8e0 as e, pm_dec * pi() / 648000000e0 * 26.8e0 as n from stars),
m as (select star_id, cos(d) * cos(r) - sin(r) * e - sin(d) * cos(r) * n + 0.00006e0 as x, cos(d) * sin(r) + cos(r) * e - sin(d) * sin(r) * n - 0.00007e0 as y, sin(d) + cos(d) * n + 0.00003e0 as z from q),
u as (select star_id, x / sqrt(x * x + y * y + z * z) as x, y / sqrt(x * x + y * y + z * z) as y, z / sqrt(x * x + y * y + z * z) as z from m)
select star_id, round(0.8e0 * x + 0.6e0 * y, 6) + 0e0 as x, round(-0.6e0 * x + 0.8e0 * y, 6) + 0e0 as y, round(z, 6) + 0e0 as z from u""")
def h16(spark, d):
    velocity = F.array(*[F.lit(v) for v in (0.00006, -0.00007, 0.00003)])
    matrix = F.array(*[F.array(*[F.lit(v) for v in row]) for row in ((0.8, 0.6, 0.0), (-0.6, 0.8, 0.0), (0.0, 0.0, 1.0))])
    p = S.position_of_date("ra", "dec_deg", "pm_ra", "pm_dec", F.lit(26.8), velocity, matrix)
    out = A.stars(spark, d).withColumn("p", p)
    return out.select("star_id", *[N.r6(F.col("p")[i]).alias(n) for i, n in enumerate("xyz")])


def stops(band: int) -> str:
    s = S.COLOUR_STOPS
    parts = []
    for k, ((b0, c0), (b1, c1)) in enumerate(zip(s, s[1:])):
        t = f"((bv - ({b0!r}e0)) / {b1 - b0!r})" if k < 4 else f"greatest(0e0, least(1e0, (bv - {b0!r}e0) / {b1 - b0!r}))"
        value = f"({c0[band]!r} + ({c1[band] - c0[band]!r}) * {t})"
        parts.append(f"when bv < {b1!r}e0 then {value}" if k < 4 else f"else {value}")
    return "(case " + " ".join(parts) + " end)"


@query("h17_star_colour", with_(STARS) + f""", c as (select star_id, vmag, bv, {stops(0)} as r, {stops(1)} as g, {stops(2)} as b from stars)
select star_id, round(0.35e0 * exp(0.587787e0 * (6.5e0 - vmag)), 6) as energy, round(0.15e0 + 0.85e0 * r / (0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b), 6) as red,
  round(0.15e0 + 0.85e0 * b / (0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b), 6) as blue, round(exp(-0.216e0 * 34.3e0 * exp(-(star_id % 100) / 8.5e0)), 6) as limb from c""")
def h17(spark, d):
    r, _, b = S.colour("bv")
    return A.stars(spark, d).select("star_id", N.r6(S.energy("vmag")).alias("energy"), N.r6(r).alias("red"), N.r6(b).alias("blue"),
                                    N.r6(S.limb_transmission(F.col("star_id") % 100)[2]).alias("limb"))


@query("h18_eclipse", """with p as (select event_id, 0.0046e0 + (event_id % 7) * 0.0001e0 as a, 0.0044e0 + (event_id % 11) * 0.0001e0 as b, (event_id % 101) * 0.0001e0 + 0.00001e0 as d from events),
h as (select *, (a + b + d) / 2 as s from p),
t as (select *, sqrt(greatest(0e0, s * (s - a) * (s - b) * (s - d))) as area from h),
q as (select *, atan2(4 * area, d * d + a * a - b * b) as al, atan2(4 * area, d * d + b * b - a * a) as be from t)
select event_id, round(greatest(0e0, least(1e0, 1 - case when d >= a + b then 0 when d <= abs(a - b) then least(a, b) * least(a, b) else (a * a * al + b * b * be - 2 * area) / pi() end / (a * a))), 6) + 0e0 as visible from q""")
def h18(spark, d):
    p = A.table(spark, d, "events").selectExpr("event_id", "0.0046e0 + (event_id % 7) * 0.0001e0 as a", "0.0044e0 + (event_id % 11) * 0.0001e0 as b",
                                               "(event_id % 101) * 0.0001e0 + 0.00001e0 as d")
    return p.select("event_id", N.r6(sky.visible_fraction("a", "b", "d")).alias("visible"))


@query("h19_sun_and_moon_light", """with p as (select event_id, 147000000e0 + value * 10000e0 as sun, (event_id % 180)::double as a, 56e0 + user_id % 8 as moon from events)
select event_id, round(1361e0 * pow(149597870.7e0 / sun, 2e0), 6) as irradiance, round(2500e0 * exp(-ln(10e0) * (0.0104e0 * a + 1.6e-9 * pow(a, 4e0))) * pow(60.27e0 / moon, 2e0), 6) as moonlight from p""")
def h19(spark, d):
    p = A.table(spark, d, "events").selectExpr("event_id", "147000000e0 + value * 10000e0 as sun", "cast(event_id % 180 as double) as a", "56e0 + user_id % 8 as moon")
    return p.select("event_id", N.r6(sky.irradiance("sun")).alias("irradiance"), N.r6(1e9 * sky.moonlight("a", "moon")).alias("moonlight"))


@query("h20_earth_fixed", """with p as (select event_id, value / 500e0 as x, (user_id % 100) / 100e0 as y, (event_id % 628) / 100e0 as th, 300000e0 + value * 1000 as km from events)
select event_id, round(cos(th) * x + sin(th) * y, 6) + 0e0 as ex, round(cos(th) * y - sin(th) * x, 6) + 0e0 as ey, round(asin(1737.4e0 / km), 6) as radius from p""")
def h20(spark, d):
    p = A.table(spark, d, "events").selectExpr("event_id", "value / 500e0 as x", "(user_id % 100) / 100e0 as y", "(event_id % 628) / 100e0 as th", "300000e0 + value * 1000 as km")
    v = sky.earth_fixed(F.array(F.col("x"), F.col("y"), F.lit(0.0)), "th")
    return p.select("event_id", N.r6(v[0]).alias("ex"), N.r6(v[1]).alias("ey"), N.r6(sky.angular_radius(F.lit(1737.4), "km")).alias("radius"))


@query("h21_hashes", """select doc_id, list_reduce(list_prepend(2166136261::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::bigint)),
  lambda h, b: (xor(h, b) * 16777619) % 4294967296) as fnv, sha256(text) as sha from documents""")
def h21(spark, d):
    return A.table(spark, d, "documents").select("doc_id", text.fnv1a32("text").alias("fnv"), F.sha2("text", 256).alias("sha"))


def oval_sql() -> str:
    t = "t_us"
    s = solar_sql(t)
    pole = f"cos(radians(80.8e0)) * cos(radians(-72.6e0)), cos(radians(80.8e0)) * sin(radians(-72.6e0)), sin(radians(80.8e0))"
    return f"""with g as (select grid_id, y, x, (1704067200000000 + grid_id::bigint * 21600000000)::bigint as t_us, 3e0 + grid_id % 6 as kp from cells),
tt as (select distinct t_us from g),
s0 as (select t_us, cos({s['dec2']}) * cos(radians(-15e0 * ({s['hours']} - 12e0 + {s['eqt']} / 60e0))) as sx, cos({s['dec2']}) * sin(radians(-15e0 * ({s['hours']} - 12e0 + {s['eqt']} / 60e0))) as sy, sin({s['dec2']}) as sz from tt),
p0 as (select *, cos(radians(80.8e0)) * cos(radians(-72.6e0)) as px, cos(radians(80.8e0)) * sin(radians(-72.6e0)) as py, sin(radians(80.8e0)) as pz from s0),
n0 as (select *, sx - (sx * px + sy * py + sz * pz) * px as ax, sy - (sx * px + sy * py + sz * pz) * py as ay, sz - (sx * px + sy * py + sz * pz) * pz as az from p0),
n1 as (select *, ax / sqrt(ax * ax + ay * ay + az * az) as nx, ay / sqrt(ax * ax + ay * ay + az * az) as ny, az / sqrt(ax * ax + ay * ay + az * az) as nz from n0),
f as (select *, py * nz - pz * ny as ex, pz * nx - px * nz as ey, px * ny - py * nx as ez from n1),
c as (select g.*, f.* exclude (t_us), cos(radians(90e0 - (y + 0.5e0) * 1.125e0)) * cos(radians(-180e0 + (x + 0.5e0) * 1.8e0)) as ux, cos(radians(90e0 - (y + 0.5e0) * 1.125e0)) * sin(radians(-180e0 + (x + 0.5e0) * 1.8e0)) as uy, sin(radians(90e0 - (y + 0.5e0) * 1.125e0)) as uz from g join f using (t_us)),
m as (select *, abs(degrees(asin(greatest(-1e0, least(1e0, ux * px + uy * py + uz * pz))))) as ml, -cos(atan2(ux * ex + uy * ey + uz * ez, ux * nx + uy * ny + uz * nz)) as night from c),
o as (select *, 66e0 - 1.8e0 * kp - 4e0 * night as i, 73e0 - 0.8e0 * kp - 3.5e0 * night as o from m),
z as (select *, (ml - i) / greatest(1e0, o - i) as d from o)
select grid_id, y, x, round_even(255e0 * greatest(0e0, least(1e0, least(0.9e0, 0.15e0 + 0.1e0 * kp) * (0.55e0 + 0.45e0 * night) * exp(-pow((d - 0.45e0) / 0.32e0, 2e0)))), 0)::int as p from z"""


def storm_oval(spark, d):
    """The synthetic oval on the raster: time terms once per grid, then one expression per cell."""
    cells = A.cells(spark, d).select("grid_id", "y", "x")
    times = cells.select("grid_id").distinct().select(
        "grid_id", (F.lit(1_704_067_200_000_000) + F.col("grid_id").cast("bigint") * 6 * timefn.HOUR_US).alias("t_us"),
        (3.0 + F.col("grid_id") % 6).alias("kp"))
    terms = oval.with_time_terms(times, "t_us").drop("t_us")
    p = oval.probability_byte(geo.row_lat("y", A.H), geo.col_lon("x", A.W), "noon", "east", F.col("kp"))
    return cells.join(terms, "grid_id").select("grid_id", "y", "x", p.alias("p"))


@query("h23_storm_oval", with_(CELLS) + ", " + oval_sql()[5:])
def h23(spark, d):
    return storm_oval(spark, d)


@query("h25_text_helpers", """select event_id, cast(json_extract(props, '$.k') as bigint) as k, 'v' || (event_id % 5) as tag, user_id::varchar as user_text,
  case when event_id % 9 = 0 then null else (epoch_us(ts) - epoch_us(ts) % 1000000)::bigint end as t_us from events""")
def h25(spark, d):
    ev = A.table(spark, d, "events").selectExpr(
        "event_id", "props", "concat('pre:v', event_id % 5) as p", "concat('user=', user_id, ' noise user=', user_id, ' z=1') as kv",
        "case when event_id % 9 = 0 then 'not a time' else concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') end as iso")
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), text.strip_prefix("p", "pre:").alias("tag"),
                     text.key_values("kv")["user"].alias("user_text"), timefn.iso_z("iso").alias("t_us"))


@query("h26_format_bytes", """with f as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_linenumber % 6 when 0 then 'BC1' when 1 then 'BC4' when 2 then 'BC5' when 3 then 'BC7' when 4 then 'R16' else 'RAW' end as f from lineitem)
select f as format, count(*) as n, max(case when f in ('BC1', 'BC4') then 34848 when f in ('BC5', 'BC7') then 69696 when f = 'R16' then 139392 end)::bigint as bytes,
  sum(case when (l_partkey & ~7::bigint) <> 0 then 1 else 0 end)::bigint as unknown_flags from f group by 1""")
def h26(spark, d):
    fmt = F.element_at(F.array(*[F.lit(f) for f in ("BC1", "BC4", "BC5", "BC7", "R16", "RAW")]), F.col("l_linenumber") % 6 + 1)
    items = A.table(spark, d, "lineitem").select(fmt.alias("format"), "l_partkey")
    return items.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.max(T.tile_bytes("format")).alias("bytes"),
                                       F.count_if(T.has_unknown_flags(F.col("l_partkey").cast("int"))).alias("unknown_flags"))
