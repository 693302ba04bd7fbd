"""Window functions and neighbourhood kernels."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import numeric as N
from ..functions.timefn import CHUNK_US
from ..operators import kernels as K, ordered, regrid as G, seams, tracks
from ..plans import benchmarks
from .joins import SEAMS, fixed_starts
from .registry import query
from .views import BYTES, CELLS, ELE, GEN, IDX, OBS, SKY, TEL, r6, spread, with_


@query("e1_lead_byte_range", with_(IDX) + """select file_id, line_no, name, start_byte,
  lead(start_byte) over (partition by file_id order by line_no) - 1 as end_byte from idx""")
def e1(spark, d):
    f = F.split("text", ":")
    lines = A.index_lines(spark, d).select("file_id", "line_no", f[3].alias("name"), f[1].cast("bigint").alias("start_byte"))
    out = ordered.neighbour(lines, ["file_id"], ["line_no"], 100_000, {"_n": F.col("start_byte")})
    return out.withColumn("end_byte", F.col("_n") - 1).drop("_n")


@query("e2_polar_lowpass", with_(CELLS) + """,
rows as (select grid_id, y, greatest(1, round_even(least(1e0 / greatest(cos(radians(90e0 - (y + 0.5e0) * 1.125e0)), 1e-6), 100e0), 0)::int) as k,
  list(v order by x) as r, list(here order by x) as h from (
    select g.grid_id, g.y, q.x, c.v, c.x is not null as here from (select distinct grid_id, y from cells) g
    cross join (select unnest(range(200)) as x) q left join cells c on c.grid_id = g.grid_id and c.y = g.y and c.x = q.x) f group by 1, 2),
turned as (select grid_id, y, k, r, h, list_concat(r, r, r) as r3, unnest(range(200)) as x from rows)
select grid_id, y, x::int as x, round(case when k < 2 then r[x + 1] else list_avg(r3[x + 201 - k // 2:x + 200 - k // 2 + k]) end, 6) + 0e0 as v from turned where h[x + 1]""")
def e2(spark, d):
    return K.polar_lowpass(A.cells(spark, d), ["v"], A.H, A.W).withColumn("v", N.r6("v"))


@query("e3_wrapped_edges", with_(CELLS) + """, m as (select grid_id, y, avg(v) as c from cells where x < 8 or x >= 192 group by 1, 2)
select grid_id, y, x, round(case when x < 8 then c * (1 - x / 7e0) + v * (x / 7e0) when x >= 192 then c * (1 - (199 - x) / 7e0) + v * ((199 - x) / 7e0) else v end, 6) + 0e0 as v
from cells join m using (grid_id, y)""")
def e3(spark, d):
    return K.wrap_edges(A.cells(spark, d), ["v"], A.W).withColumn("v", N.r6("v"))


NEAR = """nb as (
  select c.grid_id, c.y, c.x, c.v, e.v as e, w.v as w, s.v as s, n.v as n from cells c
  join cells e on e.grid_id = c.grid_id and e.y = c.y and e.x = (c.x + 1) % 200
  join cells w on w.grid_id = c.grid_id and w.y = c.y and w.x = (c.x + 199) % 200
  left join cells s on s.grid_id = c.grid_id and s.x = c.x and s.y = c.y + 1
  left join cells n on n.grid_id = c.grid_id and n.x = c.x and n.y = c.y - 1)"""
NORMAL = """select grid_id, y, x, round(-dx / sqrt(dx * dx + dy * dy + 1), 6) + 0e0 as nx, round(-dy / sqrt(dx * dx + dy * dy + 1), 6) + 0e0 as ny,
  round(1 / sqrt(dx * dx + dy * dy + 1), 6) + 0e0 as nz from g"""


@query("e4_slope_normals", with_(CELLS, NEAR) + """, g as (select grid_id, y, x, (e - w) * 0.4e0 as dx,
  case when n is null then s - v when s is null then v - n else (s - n) / 2 end * 0.8e0 as dy from nb) """ + NORMAL)
def e4(spark, d):
    out = K.slope_normals(A.cells(spark, d), "v", A.H, A.W)
    return out.select("grid_id", "y", "x", *[N.r6(c).alias(c) for c in ("nx", "ny", "nz")])


@query("e4_sphere_normals", with_(CELLS, NEAR) + """, g as (select grid_id, y, x,
  2000e0 * (e - w) / (2 * greatest(100e0, 6378137e0 * cos(radians(90e0 - (y + 0.5e0) * 1.125e0)) * 2 * pi() / 200)) as dx,
  2000e0 * (coalesce(n, v) - coalesce(s, v)) / ((case when s is null then 0 else 1 end + case when n is null then 0 else 1 end) * 6378137e0 * pi() / 160) as dy from nb) """ + NORMAL)
def e4b(spark, d):
    out = K.sphere_normals(A.cells(spark, d), "v", A.H, A.W, exaggeration=2000.0)
    return out.select("grid_id", "y", "x", *[N.r6(c).alias(c) for c in ("nx", "ny", "nz")])


@query("e5_sliding_median", with_(SKY, SEAMS) + """
select grid_id, seam, y, round(case when count(step) over w >= 4 then greatest(-0.1e0, least(0.1e0, quantile_cont(step, 0.5) over w)) else 0 end, 6) + 0e0 as med
from steps window w as (partition by grid_id, seam order by y rows between 4 preceding and 4 following)""")
def e5(spark, d):
    steps = seams.seam_steps(A.sky_cells(spark, d), "albedo", fixed_starts(spark, d), A.W)
    out = K.sliding_median(steps, ["grid_id", "seam"], "y", "step", 4, 4, 0.1, "med")
    return out.select("grid_id", "seam", "y", N.r6("med").alias("med"))


@query("e6_bartlett", with_(SKY, SEAMS) + """, o as (select grid_id, seam, y, coalesce(step, 0) as o from steps)
select a.grid_id, a.seam, a.y, round(sum(b.o * (1 - abs(b.y - a.y) / 5e0) / 5), 6) + 0e0 as smooth
from o a join o b on a.grid_id = b.grid_id and a.seam = b.seam and b.y between a.y - 4 and a.y + 4 group by 1, 2, 3""")
def e6(spark, d):
    steps = seams.seam_steps(A.sky_cells(spark, d), "albedo", fixed_starts(spark, d), A.W)
    out = K.bartlett(steps.withColumn("o", F.coalesce("step", F.lit(0.0))), ["grid_id", "seam"], "y", "o", 5, "smooth")
    return out.select("grid_id", "seam", "y", N.r6("smooth").alias("smooth"))


@query("e7_max_filter", with_(BYTES) + """, h as (select grid_id, y, x, max(r) over (partition by grid_id, y order by x rows between 8 preceding and 8 following) as m from bytes)
select grid_id, y, x, max(m) over (partition by grid_id, x order by y rows between 8 preceding and 8 following) as r from h""")
def e7(spark, d):
    out = K.max_filter(A.byte_cells(spark, d).select("grid_id", "y", "x", "r"), {"m": ("r", 17)}, A.H, A.W)
    return out.select("grid_id", "y", "x", F.col("m").alias("r"))


def box_sql(src: str, out: str, axis: str, other: str, whole: int, edge: float, lo: int, hi: int) -> str:
    """One extended box pass with repeated edges, written as a frame."""
    return f"""{out} as (select grid_id, y, x, (coalesce(sum(v) over (partition by grid_id, {other} order by {axis} rows between {whole} preceding and {whole} following), 0)
      + greatest(0, {lo} + {whole} - {axis}) * first_value(v) over (partition by grid_id, {other} order by {axis} rows between unbounded preceding and unbounded following)
      + greatest(0, {axis} + {whole} - {hi}) * last_value(v) over (partition by grid_id, {other} order by {axis} rows between unbounded preceding and unbounded following)
      + {edge!r} * (coalesce(lag(v, {whole + 1}) over (partition by grid_id, {other} order by {axis}), first_value(v) over (partition by grid_id, {other} order by {axis} rows between unbounded preceding and unbounded following))
        + coalesce(lead(v, {whole + 1}) over (partition by grid_id, {other} order by {axis}), last_value(v) over (partition by grid_id, {other} order by {axis} rows between unbounded preceding and unbounded following))))
      / {2 * whole + 1 + 2 * edge!r} as v from {src})"""


def blur_sql(src: str, sigma: float, pad: int = 0) -> str:
    whole, edge = K.box_radius(sigma)
    xs = [box_sql(src if i == 0 else f"bx{i - 1}", f"bx{i}", "x", "y", whole, edge, -pad, 199 + pad) for i in range(3)]
    cut = "bc as (select * from bx2 where x between 0 and 199)"
    ys = [box_sql("bc" if i == 0 else f"by{i - 1}", f"by{i}", "y", "x", whole, edge, 0, 159) for i in range(3)]
    return ",\n".join([*xs, cut, *ys])


@query("e8_gaussian_small", with_(CELLS) + """, src as (select grid_id, y, x + t * 200 as x, v from cells, (values (0), (1), (-1)) as q(t) where x + t * 200 between -3 and 202),
""" + blur_sql("src", 0.7, 3) + " select grid_id, y, x, round(v, 6) + 0e0 as v from by2")
def e8(spark, d):
    return K.gaussian(A.cells(spark, d), "v", 0.7, A.H, A.W, wrap_x=True).withColumn("v", N.r6("v"))


@query("e8_gaussian_feather", with_(SKY) + """, src as (select grid_id, y, x, case when ir is null then 255e0 else 0e0 end as v from sky),
""" + blur_sql("src", 28.0) + " select grid_id, y, x, round(v, 6) + 0e0 as v from by2")
def e8b(spark, d):
    src = A.sky_cells(spark, d).select("grid_id", "y", "x", F.when(F.col("ir").isNull(), 255.0).otherwise(0.0).alias("v"))
    return K.gaussian(src, "v", 28.0, A.H, A.W).withColumn("v", N.r6("v"))


HOLES = """h0 as (select grid_id, y, x, case when (floor(x / 6)::int * 7 + floor(y / 5)::int * 11) % 13 = 0 then null else v end as v from cells)"""


def dilate_sql(k: int) -> str:
    return f"""n{k} as (select grid_id, y, x, avg(v) as m from (
      select grid_id, y + 1 as y, x, v from h{k} union all select grid_id, y - 1, x, v from h{k}
      union all select grid_id, y, x + 1, v from h{k} union all select grid_id, y, x - 1, v from h{k}) q group by 1, 2, 3),
    h{k + 1} as (select h.grid_id, h.y, h.x, coalesce(h.v, n.m) as v from h{k} h left join n{k} n using (grid_id, y, x))"""


@query("e9_filled_holes", with_(CELLS, HOLES, *[dilate_sql(k) for k in range(2)]) + "select grid_id, y, x, round(coalesce(v, 0), 6) + 0e0 as v from h2")
def e9(spark, d):
    cells = A.cells(spark, d).withColumn("v", F.expr(
        "case when (cast(floor(x / 6) as int) * 7 + cast(floor(y / 5) as int) * 11) % 13 = 0 then null else v end"))
    return K.fill_holes(cells, "v", 2, A.H, A.W).withColumn("v", N.r6("v"))


TRACK = """tr as (
  select user_id as object_id, epoch_us(ts) as t_us, radians((user_id * 7 % 120) - 60e0 + value / 100e0) as la, radians(user_id * 2.4e0 - 180e0 + value / 50e0) as lo from events),
tv as (select object_id, t_us, cos(la) * cos(lo) as px, cos(la) * sin(lo) as py, sin(la) as pz from tr)"""


def track_points(spark, d):
    ev = A.events(spark, d)
    from ..functions.geo import unit_vector
    lat = (F.col("user_id") * 7 % 120) - 60.0 + F.col("value") / 100.0
    lon = F.col("user_id") * 2.4 - 180.0 + F.col("value") / 50.0
    return ev.select(F.col("user_id").alias("object_id"), "t_us", unit_vector(lat, lon).alias("p"))


@query("e10_track_velocity", with_(TRACK) + """, n as (select *, lag(t_us) over w as t0, lead(t_us) over w as t1, lag(px) over w as ax, lag(py) over w as ay, lag(pz) over w as az,
  lead(px) over w as bx, lead(py) over w as by_, lead(pz) over w as bz from tv window w as (partition by object_id order by t_us))
select object_id, t_us, round(sqrt(pow(bx - ax, 2e0) + pow(by_ - ay, 2e0) + pow(bz - az, 2e0)) * 6371e0 / ((t1 - t0) / 1e6), 6) + 0e0 as speed
from n where t0 is not null and t1 is not null""")
def e10(spark, d):
    out = tracks.velocity(track_points(spark, d), ["object_id"], "t_us", "p", CHUNK_US)
    return out.select("object_id", "t_us", N.r6("speed").alias("speed"))


@query("e11_great_arc", with_(TRACK) + """, n as (select *, lead(t_us) over w as t1, lead(px) over w as bx, lead(py) over w as by_, lead(pz) over w as bz from tv window w as (partition by object_id order by t_us)),
g as (select *, greatest(-1e0, least(1e0, px * bx + py * by_ + pz * bz)) as c, 0.25e0 as f from n where t1 is not null),
h as (select *, case when c > 0.9995e0 then 1 - f else sin((1 - f) * acos(c)) / sin(acos(c)) end as wa, case when c > 0.9995e0 then f else sin(f * acos(c)) / sin(acos(c)) end as wb from g),
k as (select object_id, t_us, wa * px + wb * bx as x, wa * py + wb * by_ as y, wa * pz + wb * bz as z from h)
select object_id, t_us, round(x / sqrt(x * x + y * y + z * z), 6) + 0e0 as x, round(y / sqrt(x * x + y * y + z * z), 6) + 0e0 as y, round(z / sqrt(x * x + y * y + z * z), 6) + 0e0 as z from k""")
def e11(spark, d):
    nxt = ordered.neighbour(track_points(spark, d), ["object_id"], ["t_us"], CHUNK_US, {"q": F.col("p"), "t1": F.col("t_us")})
    out = tracks.slerp(nxt.where("t1 is not null"), "p", "q", F.lit(0.25), "v")
    return out.select("object_id", "t_us", *[N.r6(F.col("v")[i]).alias(n) for i, n in enumerate("xyz")])


@query("e12_slow_runs", with_(TEL) + """, f as (select *, sum(case when wait_ms >= 60 then 0 else 1 end) over (partition by run, scene order by t_us) as k from tel)
select run, scene, count(*) as length, min(t_us) as start, max(t_us) as "end" from f where wait_ms >= 60 group by run, scene, k having count(*) >= 3""")
def e12(spark, d):
    return benchmarks.slow_runs(A.telemetry(spark, d), ["run", "scene"], ["t_us", "event_id"], F.col("wait_ms") >= 60, CHUNK_US)


@query("e13_latest_generations", with_(GEN) + """select distinct product, gen_us, rank from (
  select product, gen_us, dense_rank() over (partition by product order by gen_us desc) as rank from gen) q where rank <= 2""")
def e13(spark, d):
    from ..operators import generations
    return generations.latest(A.generation_files(spark, d), 2).withColumn("rank", F.col("rank").cast("bigint"))


@query("e14_running_offset", """select l_orderkey, l_linenumber, l_extendedprice, cast(coalesce(sum(cast(l_quantity as bigint) * 16) over (partition by l_returnflag
  order by l_orderkey, l_linenumber, l_extendedprice, l_partkey rows between unbounded preceding and 1 preceding), 0) as bigint) as payload_offset from lineitem""")
def e14(spark, d):
    items = A.table(spark, d, "lineitem").withColumn("size", F.col("l_quantity").cast("bigint") * 16)
    out = ordered.running(items, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"], None,
                          {"o": ("sum", F.col("size"))}, inclusive=False)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", F.coalesce("o", F.lit(0)).alias("payload_offset"))


def spline_sql(n: int, m: int, name: str) -> str:
    return f"""{name} as (select t, greatest(0, least({n - 1}, s)) as s, sum(case when q < 1 then (4 - 6 * q * q + 3 * q * q * q) / 6 else pow(greatest(0, 2 - q), 3e0) / 6 end) as w,
      count(*) over (partition by t) as n from (
      select t, floor(p)::int + k as s, abs(p - floor(p) - k) as q from (select t, (t + 0.5e0) * {n}e0 / {m}e0 - 0.5e0 as p from (select unnest(range({m})) as t) z) a, (values (-1), (0), (1), (2)) as b(k)) c
      group by 1, 2)"""


@query("e15_bspline_upsampled", with_(CELLS) + """, low as (select grid_id, floor(y / 8)::int as y, floor(x / 8)::int as x, avg(v) as v from cells group by 1, 2, 3),
""" + spline_sql(20, 60, "wy") + ", " + spline_sql(25, 75, "wx") + f""", r as (select grid_id, wy.t as y, x, {spread('v')} as v from low join wy on y = s group by 1, 2, 3)
select grid_id, y::int as y, wx.t::int as x, round({spread('v')}, 6) + 0e0 as v from r join wx on x = s group by 1, 2, 3""")
def e15(spark, d):
    low = G.block_mean(A.cells(spark, d), ["v"], 8, A.H, A.W)
    return G.separable(low, G.bspline_weights(20, 60), G.bspline_weights(25, 75), ["v"]).withColumn("v", N.r6("v"))


@query("e16_min_corners", with_(BYTES) + """, t as (select grid_id, greatest(0, least(159, y + dy)) as sy, (x + dx + 200) % 200 as sx, y, x from bytes, (values (-3), (3)) as a(dy), (values (-3), (3)) as b(dx))
select t.grid_id, t.y, t.x, min(r) as r, min(g) as g from t join bytes s on s.grid_id = t.grid_id and s.y = t.sy and s.x = t.sx group by 1, 2, 3""")
def e16(spark, d):
    return K.min_corners(A.byte_cells(spark, d).select("grid_id", "y", "x", "r", "g"), ["r", "g"], 3, A.H, A.W)
