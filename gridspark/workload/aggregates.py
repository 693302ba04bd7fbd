"""Aggregations."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import colour, geo, numeric as N, physics, timefn
from ..operators import kernels, pyramid as P, quantiles as Q, regrid as G, requests as R, seams
from ..plans import benchmarks, convection, quality
from .joins import fixed_starts
from .registry import query
from .views import BYTES, CELLS, REQ, SKY, TEL, linear, r6, spread, srgb, step, with_


@query("d1_mip_reduce", with_(BYTES) + f"""select grid_id, y >> 1 as y, x >> 1 as x,
  round_even({srgb('avg(' + linear('r') + ')')} * 255e0, 0)::int as r, round_even({srgb('avg(' + linear('g') + ')')} * 255e0, 0)::int as g,
  round_even({srgb('avg(' + linear('b') + ')')} * 255e0, 0)::int as b, round_even(avg(a), 0)::int as a
from bytes group by 1, 2, 3""")
def d1(spark, d):
    return P.mip_reduce(A.byte_cells(spark, d), ["r", "g", "b"], ["a"], A.H, A.W)


def level_sql(mips: int, half_up: bool) -> str:
    """The levels as a chain of common table expressions."""
    def quant(x):
        return f"floor({x} + 0.5e0)::int" if half_up else f"round_even({x}, 0)::int"
    parts = ["m0 as (select grid_id, y, x, r, a from bytes)"]
    for k in range(1, mips):
        parts.append(f"""m{k} as (select grid_id, y >> 1 as y, x >> 1 as x, {quant(srgb('avg(' + linear('r') + ')') + ' * 255e0')} as r,
          {quant('avg(a)')} as a from m{k - 1} group by 1, 2, 3)""")
    union = " union all ".join(f"select grid_id, {k} as mip, y, x, r, a from m{k}" for k in range(mips))
    return ", " + ", ".join(parts) + " " + union


@query("d2_full_pyramid", with_(BYTES) + level_sql(9, False))
def d2(spark, d):
    return P.build_pyramid(A.byte_cells(spark, d), ["r"], ["a"], A.H, A.W)


@query("d2_pyramid_half_up", with_(BYTES) + level_sql(9, True))
def d2b(spark, d):
    return P.build_pyramid(A.byte_cells(spark, d), ["r"], ["a"], A.H, A.W, rounding="half_up")


@query("d3_block_mean", with_(CELLS) + """select grid_id, floor(y / 16)::int as y, floor(x / 16)::int as x, round(avg(v), 6) + 0e0 as v
from cells where x < 192 group by 1, 2, 3""")
def d3(spark, d):
    return G.block_mean(A.cells(spark, d), ["v"], 16, A.H, A.W).withColumn("v", N.r6("v"))


def kernel_sql(n: int, m: int, name: str, axis: str, support: float, f: str) -> str:
    """Weights of one axis from ``n`` to ``m`` pixels; ``f`` is the kernel of the distance ``q``."""
    s = f"({n}e0 / {m}e0)"
    k = f"greatest({s}, 1e0)"
    return f"""{name}_d as (select t, unnest(range(greatest(0, floor((t + 0.5e0) * {s} - {support} * {k} + 0.5e0)::int),
      least({n}, floor((t + 0.5e0) * {s} + {support} * {k} + 0.5e0)::int))) as s from (select unnest(range({m})) as t) z),
{name}_w as (select t, s, {f} as w from (select t, s, abs((s + 0.5e0 - (t + 0.5e0) * {s}) / {k}) as q from {name}_d) z),
{name} as (select t, s, w / sum(w) over (partition by t) as w, count(*) over (partition by t) as n from {name}_w where w <> 0)"""


LANCZOS = "case when q = 0 then 1e0 when q < 3 then sin(pi() * q) / (pi() * q) * sin(pi() * q / 3) / (pi() * q / 3) else 0 end"
CUBIC = "case when q < 1 then (1.5e0 * q - 2.5e0) * q * q + 1 when q < 2 then (((q - 5) * q + 8) * q - 4) * -0.5e0 else 0 end"


def resize_sql(kernel: str, support: float) -> str:
    return "with " + CELLS + ",\n" + kernel_sql(160, 96, "wy", "y", support, kernel) + ",\n" + \
        kernel_sql(200, 128, "wx", "x", support, kernel) + f""",
r as (select grid_id, wy.t as y, x, {spread('v')} as v from cells join wy on y = s group by 1, 2, 3)
select grid_id, y::int as y, wx.t::int as x, round({spread('v')}, 6) + 0e0 as v from r join wx on x = s group by 1, 2, 3"""


@query("d4_resize_lanczos", resize_sql(LANCZOS, 3))
def d4(spark, d):
    return G.resize(A.cells(spark, d), ["v"], (A.H, A.W), (96, 128), "lanczos").withColumn("v", N.r6("v"))


@query("d4_resize_bicubic", resize_sql(CUBIC, 2))
def d4b(spark, d):
    return G.resize(A.cells(spark, d), ["v"], (A.H, A.W), (96, 128), "bicubic").withColumn("v", N.r6("v"))


@query("d5_white_point", with_(BYTES) + f"""select grid_id, round(quantile_cont(0.2126e0 * {linear('r')} + 0.7152e0 * {linear('g')} + 0.0722e0 * {linear('b')}, 0.99998), 6) + 0e0 as white
from bytes where y % 4 = 0 and x % 4 = 0 group by 1""")
def d5(spark, d):
    out = quality.white_point(A.byte_cells(spark, d), ["r", "g", "b"])
    return out.withColumn("white", N.r6("white"))


@query("d6_storm_threshold", with_(SKY) + """select grid_id, greatest(175e0, quantile_cont(ir, 0.99)) as threshold
from sky where abs(90e0 - (y + 0.5e0) * 1.125e0) < 50 and ir is not null group by 1""")
def d6(spark, d):
    return convection.storm_threshold(A.sky_cells(spark, d), A.H)


@query("d7_row_mean_with_minimum", with_(SKY) + """select grid_id, y, x % 40 as part, case when count(ir) >= 5 then round(avg(ir), 6) + 0e0 end as mean
from sky group by 1, 2, 3""")
def d7(spark, d):
    rows = A.sky_cells(spark, d).withColumn("part", F.col("x") % 40)
    return rows.groupBy("grid_id", "y", "part").agg(N.r6(quality.mean_if("ir", 5)).alias("mean"))


@query("d8_seam_columns", with_(SKY) + """, nom(seam, c) as (values (0, 1), (1, 41), (2, 79), (3, 113), (4, 152)),
cand as (select seam, c, o, (c + o - 3 + 200) % 200 as x from nom, (select unnest(range(7)) as o) o),
j as (select a.grid_id, seam, c, o, cand.x, case when count(a.albedo - b.albedo) >= 60 then median(abs(a.albedo - b.albedo)) else 0 end as jump
  from cand join sky a on a.x = cand.x join sky b on b.x = (cand.x + 199) % 200 and b.y = a.y and b.grid_id = a.grid_id group by 1, 2, 3, 4, 5)
select grid_id, (seam + 4) % 5 as seam, case when jump > 0 then x else c end as start from j
qualify row_number() over (partition by grid_id, seam order by jump desc, o) = 1""")
def d8(spark, d):
    return seams.locate_seams(A.sky_cells(spark, d), "albedo", A.W)


@query("d9_block_errors", with_(CELLS) + """, b as (
  select grid_id, floor(y / 16)::int as y, floor(x / 16)::int as x, avg(v) as p, avg(case when (x + y) % 5 = 0 then v * 0.9e0 else v end) as q
  from cells where x < 192 group by 1, 2, 3)
select grid_id, round(avg(abs(p - q)), 6) + 0e0 as mean, round(quantile_cont(abs(p - q), 0.99), 6) + 0e0 as p99, round(max(abs(p - q)), 6) + 0e0 as max from b group by 1""")
def d9(spark, d):
    a = A.cells(spark, d)
    b = a.withColumn("v", F.when((F.col("x") + F.col("y")) % 5 == 0, F.col("v") * 0.9).otherwise(F.col("v")))
    out = quality.block_error(a, b, "v", 16, A.H, A.W)
    return out.select("grid_id", *[N.r6(c).alias(c) for c in ("mean", "p99", "max")])


FRAME_HASHES = """fr as (select {k}, y, sha256(unhex(string_agg(printf('%02X%02X%02X', r, g, b), '' order by x))) as d from {src} group by {k}, y),
fh as (select {k}, sha256(string_agg(d, '' order by y)) as sha256 from fr group by {k})"""


@query("d10_frame_statistics", with_(BYTES, FRAME_HASHES.format(k="grid_id", src="bytes")) + """select grid_id, least(min(r), min(g), min(b)) as lo, greatest(max(r), max(g), max(b)) as hi,
  round((avg(r) + avg(g) + avg(b)) / 3, 6) + 0e0 as mean, round(avg(case when greatest(r, g, b) > 3 then 1e0 else 0e0 end), 6) + 0e0 as lit, any_value(sha256) as sha256
from bytes join fh using (grid_id) group by 1""")
def d10(spark, d):
    cells = A.byte_cells(spark, d)
    out = quality.frame_stats(cells, ["grid_id"], ["r", "g", "b"]).join(quality.frame_hashes(cells, ["grid_id"], ["r", "g", "b"]), "grid_id")
    return out.select("grid_id", "lo", "hi", N.r6("mean").alias("mean"), N.r6("lit").alias("lit"), "sha256")


@query("d11_scene_summary", with_(TEL) + """select run, scene, count(*) as samples, round(median(wait_ms), 6) + 0e0 as median,
  arg_max(wait_ms, t_us) as last, round((arg_max(wait_ms, t_us) - arg_min(wait_ms, t_us)) / ((max(t_us) - min(t_us)) / 1e6), 6) + 0e0 as rate
from tel group by 1, 2""")
def d11(spark, d):
    out = benchmarks.scene_summary(A.telemetry(spark, d), ["run", "scene"], "wait_ms", "t_us", ["event_id"])
    return out.select("run", "scene", "samples", N.r6("median").alias("median"), "last", N.r6("rate").alias("rate"))


@query("d12_request_counts", with_(REQ) + "select layer, mip, y, x, count(*) as priority from req group by 1, 2, 3, 4")
def d12(spark, d):
    return R.count_requests(A.requests(spark, d))


@query("d13_merged_requests", with_(REQ) + """select layer, mip, y, x, max(priority) as priority, max(kind) as kind, max(frame) as frame
from req group by 1, 2, 3, 4""")
def d13(spark, d):
    return R.merge_requests(A.requests(spark, d))


@query("d14_folded_parents", with_(REQ) + """, s as (select layer, mip, y, x, priority, frame from req where mip < 3
  union all select layer, mip + 1, y >> 1, x >> 1, priority, frame from req where mip + 1 < 3)
select layer, mip, y, x, sum(priority)::bigint as priority, max(frame) as frame from s group by 1, 2, 3, 4""")
def d14(spark, d):
    return R.fold_parents(A.requests(spark, d), 3)


@query("d15_mip_histogram", with_(REQ) + """select layer, mip, count(*) as requests, count(distinct (layer, mip, y, x)) as tiles,
  grouping(layer, mip)::int as level from req group by cube (layer, mip)""")
def d15(spark, d):
    return R.mip_histogram(A.requests(spark, d))


STORE = """store as (
  select doc_id % 3 as store_id, 1 as layer, 0 as mip, floor(doc_id / 100)::int as y, (doc_id % 100)::int as x,
    n_chars as bytes, (doc_id * 7919 % 100003) * 60000 as last_used, doc_id % 7 = 0 as pinned from documents)"""


def tile_store(spark, d):
    return A.table(spark, d, "documents").selectExpr(
        "doc_id % 3 as store_id", "1 as layer", "0 as mip", "cast(floor(doc_id / 100) as int) as y",
        "cast(doc_id % 100 as int) as x", "n_chars as bytes", "(doc_id * 7919 % 100003) * 60000 as last_used", "doc_id % 7 = 0 as pinned")


@query("d16_resident_bytes", with_(STORE) + """select store_id, sum(bytes)::bigint as resident, sum(case when pinned then bytes else 0 end)::bigint as pinned_bytes,
  count(*) as tiles, sum(bytes) > 500000 as over_budget from store group by 1""")
def d16(spark, d):
    return tile_store(spark, d).groupBy("store_id").agg(
        F.sum("bytes").alias("resident"), F.sum(F.when(F.col("pinned"), F.col("bytes")).otherwise(0)).alias("pinned_bytes"),
        F.count(F.lit(1)).alias("tiles"), (F.sum("bytes") > 500_000).alias("over_budget"))


@query("d17_distinct_nodes", with_(REQ) + """select mip, count(*) as points, count(distinct (y, x)) as nodes, count(*) = count(distinct (y, x)) as is_unique from req group by 1""")
def d17(spark, d):
    return quality.distinct_nodes(A.requests(spark, d), ["mip"], ["y", "x"])


@query("d18_metered_key", with_(BYTES) + """, p as (
  select grid_id, r / 255e0 as lum, r > 100 as lit, a / 255e0 as cov,
    cast(floor((a / 255e0) * (1 - (pow((x + 0.5e0) / 200e0 - 0.5e0, 2e0) + pow((y + 0.5e0) / 160e0 - 0.5e0, 2e0))) * 1000000 + 0.5e0) as bigint) as w
  from bytes where a / 255e0 >= 0.25e0),
q as (select grid_id, list_sort(list(lum) filter (lit))[least(count(*) filter (lit) * 99 // 100, count(*) filter (lit) - 1) + 1] as ref from p group by 1),
k as (select p.* from p left join q using (grid_id) where not lit or ref is null or lum >= ref * 0.002e0),
c as (select grid_id, lum, sum(w) over (partition by grid_id order by lum) as cum, sum(w) over (partition by grid_id) as total from k)
select grid_id, round(min(lum), 6) + 0e0 as key from c where cum >= 0.85e0 * total group by 1""")
def d18(spark, d):
    pixels = A.byte_cells(spark, d).selectExpr(
        "grid_id", "y", "x", "r / 255e0 as lum", "r > 100 as lit", "a / 255e0 as coverage")
    return quality.metered_key(pixels, ["grid_id"], A.H, A.W).withColumn("key", N.r6("key"))


FRAMES = "f as (select grid_id, x % 4 as frame, y, floor(x / 4)::int as x, r, g, b from bytes)"


@query("d19_flash_counts", with_(BYTES, FRAMES, FRAME_HASHES.format(k="grid_id, frame", src="f")) + """, m as (select *, min(r) over w as mr, min(g) over w as mg, min(b) over w as mb from f window w as (partition by grid_id, y, x)),
n as (select grid_id, count(distinct sha256) as distinct_frames from fh group by 1)
select grid_id, frame, sum(case when greatest(r - mr, g - mg, b - mb) > 20 then 1 else 0 end)::bigint as flashes, any_value(sha256) as sha256, any_value(distinct_frames) as distinct_frames
from m join fh using (grid_id, frame) join n using (grid_id) group by 1, 2""")
def d19(spark, d):
    frames = A.byte_cells(spark, d).selectExpr("grid_id", "x % 4 as frame", "y", "cast(floor(x / 4) as int) as x", "r", "g", "b")
    hashes = quality.frame_hashes(frames, ["grid_id", "frame"], ["r", "g", "b"])
    distinct = hashes.groupBy("grid_id").agg(F.count_distinct("sha256").alias("distinct_frames"))
    return quality.flash_counts(frames, ["grid_id"], "frame", ["r", "g", "b"], 20).join(hashes, ["grid_id", "frame"]).join(distinct, "grid_id")


@query("d20_flash_rates", with_(BYTES) + f""", c as (
  select grid_id, floor(y / 4)::int as cy, floor(x / 4)::int as cx, avg(r) / 255e0 as cape, avg(g) / 255e0 as rain, avg(b) / 255e0 as cloud from bytes group by 1, 2, 3),
f as (select grid_id, floor(cy / 10)::int as band, cy, cx, 0.17e0 * {step('0.025e0', '0.4e0', 'cape')} * {step('0.05e0', '0.5e0', 'rain')} * {step('0.3e0', '0.8e0', 'cloud')}
  * cos(radians(90e0 - (cy + 0.5e0) * 4.5e0)) as rate from c)
select grid_id, band, round(sum(rate), 6) + 0e0 as rate, count(*) as cells from f group by rollup (grid_id, band)""")
def d20(spark, d):
    return convection.flash_rates(A.byte_cells(spark, d), A.H, A.W, 4, 10).withColumn("rate", N.r6("rate"))


@query("d21_before_after_summary", with_(TEL) + """, s as (select scene, avg(wait_ms) filter (run = 'before') as before, avg(wait_ms) filter (run = 'after') as after,
  count(*) as samples, string_agg(distinct run, ',' order by run) as runs, grouping(scene)::int as total from tel group by grouping sets ((scene), ()))
select scene, total, samples, runs, round(before, 6) + 0e0 as before, round(after, 6) + 0e0 as after, round((1 - after / before) * 100, 6) + 0e0 as reduction from s""")
def d21(spark, d):
    out = benchmarks.ab_summary(A.telemetry(spark, d), "wait_ms")
    return out.select("scene", "total", "samples", "runs", *[N.r6(c).alias(c) for c in ("before", "after", "reduction")])


@query("d22_area_quantiles", with_(CELLS) + """, w as (select grid_id, v, cast(floor(cos(radians(90e0 - (y + 0.5e0) * 1.125e0)) * 1000000 + 0.5e0) as bigint) as w from cells),
c as (select grid_id, v, sum(w) over (partition by grid_id order by v) as cum, sum(w) over (partition by grid_id) as total from w)
select grid_id, """ + ", ".join(f"round(min(v) filter (cum >= {p} * total), 6) + 0e0 as q{n}" for n, p in
                                ((1, "0.01e0"), (10, "0.1e0"), (50, "0.5e0"), (90, "0.9e0"), (99, "0.99e0"))) + " from c group by 1")
def d22(spark, d):
    out = quality.area_quantiles(A.cells(spark, d), "v", A.H, {"q1": 0.01, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99})
    return out.select("grid_id", *[N.r6(c).alias(c) for c in ("q1", "q10", "q50", "q90", "q99")])


@query("d23_detection_scores", with_(BYTES) + """, s as (select *, max(case when g > 200 then 1 else 0 end) over (partition by grid_id, y order by x rows between 4 preceding and 4 following) as m from bytes),
t as (select *, max(m) over (partition by grid_id, x order by y rows between 4 preceding and 4 following) as near from s)
select grid_id, sum(case when r > 180 then 1 else 0 end)::bigint as tops, round(avg(case when r > 180 then near::double end), 6) + 0e0 as matched,
  round(sum(case when b < 60 then g else 0 end) / sum(g)::double, 6) + 0e0 as clear_share from t group by 1""")
def d23(spark, d):
    cells = A.byte_cells(spark, d)
    storms = cells.select("grid_id", "y", "x", (F.col("g") > 200).cast("int").alias("storm"), (F.col("r") > 180).alias("top"),
                          F.col("g").alias("rate"), (F.col("b") < 60).alias("clear"))
    out = convection.storm_scores(storms, A.H, A.W, 9)
    return out.select("grid_id", "tops", N.r6("matched").alias("matched"), N.r6("clear_share").alias("clear_share"))


@query("d24_frame_rate", with_(TEL) + """select run, (t_us - t_us % 3600000000)::bigint as window_us, count(*) as frames, round(count(*) / 3600e0, 6) as rate from tel group by 1, 2""")
def d24(spark, d):
    return benchmarks.frame_rate(A.telemetry(spark, d), ["run"], "t_us", timefn.HOUR_US)
