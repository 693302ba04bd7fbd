"""Joins: as-of, range, placement, fallback, anti."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import geo, numeric as N, timefn
from ..operators import asof, kernels, pyramid as P, regrid as G, requests as R, seams
from ..operators.grids import dense_grid
from ..plans import benchmarks, fuse
from .registry import query
from .scans import grid_layers
from .views import BYTES, CELLS, ELE, OBS, REQ, SKY, TEL, clip, r6, spread, with_

HOUR = timefn.HOUR_US
CHUNK_US = timefn.CHUNK_US
DAY = timefn.DAY_US

CYC = """m as (
  select distinct user_id % 10 as model, (epoch_us(ts) - epoch_us(ts) % 21600000000)::bigint as cycle_us, event_type as name from events),
ok as (select model, cycle_us from m where name in ('view', 'click', 'error') group by 1, 2 having count(*) = 3),
rq as (select event_id as request_id, user_id % 10 as model, epoch_us(ts) as now_us from events where event_type = 'purchase')"""


@query("c1_latest_complete_cycle", "with " + CYC + """
select rq.model, request_id, now_us, max(cycle_us) as cycle_us from rq join ok on ok.model = rq.model
  and cycle_us <= now_us and cycle_us > now_us - now_us % 21600000000 - 9 * 21600000000
group by 1, 2, 3""")
def c1(spark, d):
    ev = A.events(spark, d)
    messages = ev.select((F.col("user_id") % 10).alias("model"), timefn.floor_to("t_us", 6 * HOUR).alias("cycle_us"),
                         F.col("event_type").alias("name")).distinct()
    asked = ev.where("event_type = 'purchase'").select(
        (F.col("user_id") % 10).alias("model"), F.col("event_id").alias("request_id"), F.col("t_us").alias("now_us"))
    return asof.latest_complete_cycle(messages, asked, ["view", "click", "error"], 9, 6 * HOUR, ["model"])


@query("c2_asof_elements", with_(ELE) + """select i.object_id, i.t_us, i.instant_id, e.element_id, e.epoch_us as matched_at
from ins i asof left join ele e on i.object_id = e.object_id and i.t_us >= e.epoch_us""")
def c2(spark, d):
    return asof.asof_join(A.instants(spark, d), A.elements(spark, d), ["object_id"], "t_us", "epoch_us",
                          ["element_id"], CHUNK_US, tie=["element_id"])


@query("c2_asof_within_two_days", with_(ELE) + """select i.object_id, i.t_us, i.instant_id,
  case when i.t_us - e.epoch_us <= 172800000000 then e.element_id end as element_id,
  case when i.t_us - e.epoch_us <= 172800000000 then e.epoch_us end as matched_at
from ins i asof left join ele e on i.object_id = e.object_id and i.t_us >= e.epoch_us""")
def c2b(spark, d):
    return asof.asof_join(A.instants(spark, d), A.elements(spark, d), ["object_id"], "t_us", "epoch_us",
                          ["element_id"], CHUNK_US, tolerance=2 * DAY, tie=["element_id"])


# A Mercator-like source axis: 160 rows from 72 N to 72 S; the target is a 90 x 120 global grid.
def source_lats():
    return [72.0 - 144.0 * i / 159 for i in range(160)]


@query("c3_regrid_bilinear", with_(SKY) + """,
ty as (select unnest(range(90)) as ty), tx as (select unnest(range(120)) as tx),
ry as (select ty, (72e0 - (90e0 - (ty + 0.5e0) * 2e0)) / (144e0 / 159) as p from ty),
wy as (select ty, cast(least(158, floor(p)) as int) as y, 1 - (p - least(158, floor(p))) as w from ry where p between 0 and 159
  union all select ty, cast(least(158, floor(p)) as int) + 1, p - least(158, floor(p)) from ry where p between 0 and 159),
rx as (select tx, greatest(0e0, least(199e0, ((tx + 0.5e0) * 3e0) / 1.8e0 - 0.5e0)) as p from tx),
wx as (select tx, cast(least(198, floor(p)) as int) as x, 1 - (p - least(198, floor(p))) as w from rx
  union all select tx, cast(least(198, floor(p)) as int) + 1, p - least(198, floor(p)) from rx),
a as (select grid_id, ty, x, case when count(albedo) = 2 then sum(albedo * w) end as v from sky join wy using (y) group by 1, 2, 3),
b as (select grid_id, ty, tx, case when count(v) = 2 then sum(v * w) end as v from a join wx using (x) group by 1, 2, 3)
select g.grid_id, ty.ty::int as y, tx.tx::int as x, round(b.v, 6) + 0e0 as albedo
from (select distinct grid_id from sky) g, ty, tx left join b on b.grid_id = g.grid_id and b.ty = ty.ty and b.tx = tx.tx""")
def c3(spark, d):
    cells = A.sky_cells(spark, d).select("grid_id", "y", "x", "albedo")
    lat = [-v for v in source_lats()]
    rows = G.linear_weights(G.axis_index(lat, [-(90.0 - (t + 0.5) * 2.0) for t in range(90)]), 160)
    lon = [-180.0 + (i + 0.5) * 1.8 for i in range(200)]
    cols = G.linear_weights(G.axis_index(lon, [-180.0 + (t + 0.5) * 3.0 for t in range(120)], "clamp"), 200)
    out = G.separable(cells, rows, cols, ["albedo"])
    full = dense_grid(cells.select("grid_id").distinct(), 90, 120)
    return full.join(out, ["grid_id", "y", "x"], "left").withColumn("albedo", N.r6("albedo"))


@query("c4_axis_index", """with a as (
  select user_id as axis_id, row_number() over (partition by user_id order by ts) - 1 as i, epoch_us(ts)::double as c
  from events where event_type = 'click'),
p as (select axis_id, i, c as c0, lead(c) over (partition by axis_id order by i) as c1 from a),
t as (select user_id as axis_id, event_id as target, epoch_us(ts)::double as c from events where event_type = 'error')
select t.axis_id, t.target, round(case when t.c = p.c0 then p.i else p.i + (t.c - p.c0) / (p.c1 - p.c0) end, 6) + 0e0 as pos
from t asof left join p on t.axis_id = p.axis_id and t.c >= p.c0""")
def c4(spark, d):
    from ..operators.ordered import running
    ev = A.events(spark, d)
    points = ev.where("event_type = 'click'").select(F.col("user_id").alias("axis_id"), F.col("t_us").cast("double").alias("coord"))
    axis = running(points, ["axis_id"], ["coord"], CHUNK_US, {"i": ("count", F.lit(1))}, inclusive=False)
    targets = ev.where("event_type = 'error'").select(
        F.col("user_id").alias("axis_id"), F.col("event_id").alias("target"), F.col("t_us").cast("double").alias("coord"))
    return G.axis_index_table(axis, targets, CHUNK_US).withColumn("pos", N.r6("pos"))


POLAR = """pr as (
  select event_id, grid_id, lat, lon, case when lat > 0 then 1e0 else -1e0 end as s from pts),
t as (select *, radians(lat) * s as phi, radians(lon + 45e0) * s as lam, sqrt(1e0 - pow(6356.889449e0 / 6378.273e0, 2e0)) as e from pr),
k as (select *, 6378.273e0 * (cos(radians(70e0)) / sqrt(1e0 - e * e * sin(radians(70e0)) * sin(radians(70e0))))
   * (tan(pi() / 4 - phi / 2) / pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2))
   / (tan(pi() / 4 - radians(70e0) / 2) / pow((1 - e * sin(radians(70e0))) / (1 + e * sin(radians(70e0))), e / 2)) as rho from t),
xy as (select event_id, grid_id, s * rho * sin(lam) as px, -s * rho * cos(lam) as py from k)"""
PTS = """pts as (select event_id, cast(event_id % (select count(distinct grid_id) from cells) as int) as grid_id, case when event_id % 2 = 0 then 1 else -1 end * (36e0 + (event_id * 7 % 530) / 10e0) as lat,
  (event_id * 13 % 3600) / 10e0 - 180e0 as lon from events)"""


@query("c5_nearest_projected", with_(CELLS, PTS, POLAR) + """, q as (
  select *, round_even((px + 5000e0) / 50e0, 0) as sx, round_even((py - 4000e0) / -50e0, 0) as sy from xy)
select event_id, round(coalesce(c.v, 0e0), 6) + 0e0 as v from q left join cells c on c.grid_id = q.grid_id and c.x = sx and c.y = sy""")
def c5(spark, d):
    grids = A.table(spark, d, "embeddings").agg(F.count_distinct(F.floor(F.col("vec_id") / 500))).first()[0]
    pts = A.table(spark, d, "events").selectExpr(
        "event_id", f"cast(event_id % {grids} as int) as grid_id", "case when event_id % 2 = 0 then 1 else -1 end * (36e0 + (event_id * 7 % 530) / 10e0) as lat",
        "(event_id * 13 % 3600) / 10e0 - 180e0 as lon")
    px, py = geo.polar_stereographic("lat", "lon", a_km=6378.273, b_km=6356.889449, lat_ts=70.0, lon_0=-45.0, north=F.col("lat") > 0)
    out = G.nearest_projected(A.cells(spark, d), "v", pts, px, py, -5000.0, 50.0, 4000.0, -50.0, ["grid_id"])
    return out.select("event_id", N.r6("v").alias("v"))


@query("c6_nodes_to_centres", with_(CELLS) + """, c as (
  select grid_id, a.y + dy as y, (a.x + dx + 200) % 200 as x, v from cells a, (values (0), (-1)) as q(dy), (values (0), (-1)) as p(dx))
select grid_id, y::int as y, ((x + 100) % 200)::int as x, round(case when count(v) = 4 then sum(v) / 4 end, 6) + 0e0 as v from c where y between 0 and 158 group by 1, 2, 3""")
def c6(spark, d):
    return G.nodes_to_centres(A.cells(spark, d), "v", A.W, A.H).withColumn("v", N.r6("v"))


@query("c7_fused_sources", with_(SKY) + """,
aer as (select grid_id, y, x, model * 2 as tau, low * 3 as alpha from sky where grid_id % 2 = 0 and (x + y) % 3 <> 0),
ice as (select grid_id, y, x, cosine as ice from sky where y < 30 or y > 130)
select s.grid_id, s.y, s.x, round(coalesce(s.albedo, s.model), 6) + 0e0 as cover,
  round(coalesce(i.ice, (s.ir - 90e0) / 125e0), 6) + 0e0 as green,
  round(case when a.tau is not null then (a.alpha + 0.5e0) / 3e0 when s.ir is null then 0e0 else 1e0 end, 6) + 0e0 as blue,
  round(case when a.tau is not null then sqrt(greatest(0e0, a.tau) / 4e0) else 1e0 end, 6) + 0e0 as alpha
from sky s left join aer a using (grid_id, y, x) left join ice i using (grid_id, y, x)""")
def c7(spark, d):
    sky = A.sky_cells(spark, d)
    aerosol = sky.where("grid_id % 2 = 0 and (x + y) % 3 <> 0").selectExpr("grid_id", "y", "x", "model * 2 as tau", "low * 3 as angstrom")
    ice = sky.where("y < 30 or y > 130").selectExpr("grid_id", "y", "x", "cosine as ice")
    observed = sky.selectExpr("grid_id", "y", "x", "coalesce(albedo, model) as cover", "(ir - 90e0) / 125e0 as coldness",
                              "ir is null as missing")
    out = fuse.fuse_sources(observed, aerosol, ice)
    return out.select("grid_id", "y", "x", *[N.r6(c).alias(c) for c in ("cover", "green", "blue", "alpha")])


SEAMS = """st(seam, c0) as (values (0, 41), (1, 79), (2, 113), (3, 152), (4, 1)),
strip as (
  select grid_id, seam, y, k, east, albedo from sky join (
    select seam, unnest(range(4)) as k, 1 as east, c0 from st union all select seam, unnest(range(4)), 0, c0 from st) q
  on x = (case when east = 1 then c0 + 2 + k else c0 - 3 - k + 200 end) % 200),
steps as (
  select grid_id, seam, y,
    case when count(albedo) filter (east = 1) >= 2 then avg(albedo) filter (east = 1) end
    - case when count(albedo) filter (east = 0) >= 2 then avg(albedo) filter (east = 0) end as step
  from strip group by 1, 2, 3)"""


def fixed_starts(spark, d):
    grids = A.sky_cells(spark, d).select("grid_id").distinct()
    nominal = F.array(*[F.struct(F.lit(i).alias("seam"), F.lit(c).alias("start")) for i, c in enumerate(seams.seam_columns(A.W))])
    return grids.select("grid_id", F.inline(nominal))


@query("c8_seam_steps", with_(SKY, SEAMS) + "select grid_id, seam, y, round(step, 6) + 0e0 as step from steps")
def c8(spark, d):
    return seams.seam_steps(A.sky_cells(spark, d), "albedo", fixed_starts(spark, d), A.W).withColumn("step", N.r6("step"))


@query("c9_seam_correction", with_(SKY, SEAMS) + """, off as (
  select grid_id, seam, y, greatest(-0.5e0, least(0.5e0, step)) as o from steps where step is not null),
k as (select unnest(range(11)) as k),
cor as (select grid_id, y, ((c0 + k.k) % 200) as x, greatest(o, 0) * 0.5e0 * (1 + cos(pi() * (k.k + 0.5e0) / 11)) as c from off join st using (seam), k
  union all select grid_id, y, ((c0 - 1 - k.k + 200) % 200), greatest(-o, 0) * 0.5e0 * (1 + cos(pi() * (k.k + 0.5e0) / 11)) from off join st using (seam), k),
s as (select grid_id, y, x, sum(c) as c from cor group by 1, 2, 3)
select grid_id, y, x, round(albedo - coalesce(c, 0), 6) + 0e0 as albedo from sky left join s using (grid_id, y, x)""")
def c9(spark, d):
    sky, starts = A.sky_cells(spark, d), fixed_starts(spark, d)
    steps = seams.seam_steps(sky, "albedo", starts, A.W).where("step is not null")
    offsets = steps.select("grid_id", "seam", "y", N.clip("step", -0.5, 0.5).alias("offset"))
    out = seams.apply_offsets(sky.select("grid_id", "y", "x", "albedo"), "albedo", offsets, starts, A.W)
    return out.withColumn("albedo", N.r6("albedo"))


@query("c10_nearest_satellite", """with e as (select event_id, (event_id * 13 % 3600) / 10e0 - 180e0 as lon from events),
s(i, s) as (values (0, -137e0), (1, -75.2e0), (2, 0e0), (3, 45.5e0), (4, 140.7e0)),
q as (select event_id, i, least(abs(lon - s), 360e0 - abs(lon - s)) as d from e, s)
select event_id, i as sector from q qualify row_number() over (partition by event_id order by d, i) = 1""")
def c10(spark, d):
    return A.table(spark, d, "events").select(
        "event_id", seams.sector_of((F.col("event_id") * 13 % 3600) / 10.0 - 180.0).alias("sector"))


@query("c11_area_overlap", with_(CELLS) + f""",
wy as (select t, s, (least((t + 1) * 2.5e0, s + 1e0) - greatest(t * 2.5e0, s)) / 2.5e0 as w, count(*) over (partition by t) as n from (
  select t, unnest(range(floor(t * 2.5e0)::int, ceil((t + 1) * 2.5e0)::int)) as s from (select unnest(range(64)) as t) a) b),
wx as (select t, s, (least((t + 1) * 3.125e0, s + 1e0) - greatest(t * 3.125e0, s)) / 3.125e0 as w, count(*) over (partition by t) as n from (
  select t, unnest(range(floor(t * 3.125e0)::int, ceil((t + 1) * 3.125e0)::int)) as s from (select unnest(range(64)) as t) a) b),
r as (select grid_id, wy.t as y, x, {spread('v')} as v from cells join wy on y = s group by 1, 2, 3)
select grid_id, y::int as y, wx.t::int as x, round({spread('v')}, 6) + 0e0 as v from r join wx on x = s group by 1, 2, 3""")
def c11(spark, d):
    return G.regrid_area(A.cells(spark, d), ["v"], (A.H, A.W), (64, 64)).withColumn("v", N.r6("v"))


@query("c12_placed_tiles", with_(BYTES) + """select grid_id, r, y % 80 + (floor(x / 50)::int % 2 + 2 * floor(y / 80)::int) * 80 as y,
  x % 50 + floor(floor(x / 50) / 2)::int * 50 as x from bytes""")
def c12(spark, d):
    cells = A.byte_cells(spark, d).selectExpr(
        "grid_id", "r", "y % 80 as y", "x % 50 as x", "concat('T', cast(floor(y / 80) * 4 + floor(x / 50) as int)) as name")
    places = spark.createDataFrame([(f"T{i}", i % 2 + i // 4 * 2, i % 4 // 2) for i in range(8)], "name string, row int, col int")
    return P.place_tiles(cells, places, 80, 50)


@query("c13_gutters", with_(BYTES) + """,
ty as (select t, l, greatest(0, least(159, t * 32 + l - 4)) as y from (select unnest(range(5)) as t) a, (select unnest(range(40)) as l) b),
tx as (select t, l, (t * 32 + l - 4 + 200) % 200 as x from (select unnest(range(7)) as t) a, (select unnest(range(40)) as l) b)
select grid_id, ty.t::int as ty, tx.t::int as tx, count(*) as n, cast(sum((ty.l * 41 + tx.l * 43 + 1) * r) as bigint) as checksum
from bytes join ty using (y) join tx using (x) group by 1, 2, 3""")
def c13(spark, d):
    padded = P.with_gutter(A.byte_cells(spark, d).select("grid_id", "y", "x", "r"), A.H, A.W, tile=32, gutter=4)
    return padded.groupBy("grid_id", "ty", "tx").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("ly") * 41 + F.col("lx") * 43 + 1) * F.col("r")).alias("checksum"))


@query("c14_parent_fallback", with_(REQ) + """, k as (select distinct layer, mip, y, x from req),
have as (select distinct layer, mip, y, x from req where event_id % 37 = 0 and mip > 0),
up as (select k.*, l.l as levels_up, mip + l.l as r_mip, y >> l.l as r_y, x >> l.l as r_x from k, (select unnest(range(4))::int as l) l where mip + l.l <= 3)
select up.* from up join have h on h.layer = up.layer and h.mip = r_mip and h.y = r_y and h.x = r_x
qualify row_number() over (partition by up.layer, up.mip, up.y, up.x order by levels_up) = 1""")
def c14(spark, d):
    req = A.requests(spark, d)
    return P.resolve_tiles(req, req.where("event_id % 37 = 0 and mip > 0"), 3)


@query("c15_pyramid_gaps", with_(REQ) + """,
want as (select 1 as layer, m.mip, y.y, x.x from (values (0, 4, 8), (1, 2, 4), (2, 1, 2), (3, 1, 1), (4, 1, 1)) as m(mip, h, w),
  (select unnest(range(4)) as y) y, (select unnest(range(8)) as x) x where y.y < h and x.x < w),
have as (select layer, mip, y, x + case when event_id % 113 = 0 then 1 else 0 end as x, count(*) as n from req where value_keep group by 1, 2, 3, 4)
select coalesce(w.layer, h.layer) as layer, coalesce(w.mip, h.mip) as mip, coalesce(w.y, h.y)::int as y, coalesce(w.x, h.x)::int as x, v as verdict
from want w full outer join have h on w.layer = h.layer and w.mip = h.mip and w.y = h.y and w.x = h.x,
  (values ('missing'), ('extra'), ('duplicate')) as q(v)
where (v = 'missing' and n is null) or (v = 'extra' and w.layer is null) or (v = 'duplicate' and n > 1)""".replace("value_keep", "true"))
def c15(spark, d):
    tiles = A.requests(spark, d).withColumn("x", F.col("x") + F.when(F.col("event_id") % 113 == 0, 1).otherwise(0))
    layers = spark.createDataFrame([(1, 8 * 256, 4 * 256, 5)], "layer int, base_w int, base_h int, mip_count int")
    return P.audit_pyramid(tiles, layers)


CHANNELS = "'day_color','surface_normal','night_emission','water_mask','cloud_density','cloud_normal','height','star_panorama','city_cloud_glow','aurora_mask','aurora_color','lightning_mask'"


@query("c16_missing_channels", f"""with ch as (select unnest([{CHANNELS}]) as channel, unnest(range(12)) as i),
h as (select distinct o_custkey as bundle, o_orderkey % 12 as i from orders), b as (select distinct o_custkey as bundle from orders)
select b.bundle, ch.channel from b, ch where not exists (select 1 from h where h.bundle = b.bundle and h.i = ch.i)""")
def c16(spark, d):
    from ..functions.tiles import CHANNEL_FORMATS
    names = F.array(*[F.lit(c) for c in CHANNEL_FORMATS])
    layers = A.table(spark, d, "orders").select(
        F.col("o_custkey").alias("bundle"), F.element_at(names, (F.col("o_orderkey") % 12 + 1).cast("int")).alias("channel"))
    return P.missing_channels(layers, ["bundle"])


AB = """s as (select event_id % 2 as side, event_type as scene, case when user_id % 3 = 0 then 2 * user_id + event_id % 2 + 1000000 else user_id end as output,
  count(*) as frames from events group by 1, 2, 3)"""


@query("c17_before_after", "with " + AB + """
select coalesce(a.scene, b.scene) as scene, coalesce(a.output, b.output) as output,
  case when b.scene is null then 'only before' when a.scene is null then 'only after'
       when a.frames is not distinct from b.frames then 'pair' else 'frames differ' end as verdict
from (select * from s where side = 0) a full outer join (select * from s where side = 1) b on a.scene = b.scene and a.output = b.output""")
def c17(spark, d):
    # A third of the outputs changes its name between the runs.
    output = F.expr("case when user_id % 3 = 0 then 2 * user_id + event_id % 2 + 1000000 else user_id end")
    runs = A.events(spark, d).groupBy(
        (F.col("event_id") % 2).alias("side"), F.col("event_type").alias("scene"), output.alias("output")).agg(
        F.count(F.lit(1)).alias("frames"))
    return benchmarks.match_runs(runs.where("side = 0").drop("side"), runs.where("side = 1").drop("side"),
                                 ["scene", "output"], ["frames"])


@query("c18_nearest_month", """with av as (select distinct o_custkey as place, month(o_orderdate)::int as m from orders where o_orderpriority <> '5-LOW' and o_orderstatus <> 'F'),
und as (select distinct o_custkey as place from orders where o_orderpriority = '5-LOW' or o_orderstatus = 'F'),
w as (select distinct c_custkey as place, (c_custkey % 12 + 1)::int as month from customer),
q as (select w.place, w.month, av.m, least(abs(av.m - w.month), 12 - abs(av.m - w.month)) as d,
  case when (av.m - w.month + 12) % 12 <= 6 then 0 else 1 end as back from w join av using (place)
  union all select w.place, w.month, 0, 99, 0 from w join und using (place))
select place, month, m as chosen from q qualify row_number() over (partition by place order by d, back) = 1""")
def c18(spark, d):
    """Dated maps by the nearest month; a place without any takes the undated one, month 0."""
    undated = (F.col("o_orderpriority") == "5-LOW") | (F.col("o_orderstatus") == "F")
    present = A.table(spark, d, "orders").select(
        F.col("o_custkey").alias("place"), F.when(undated, 0).otherwise(F.month("o_orderdate")).alias("chosen"))
    wanted = A.table(spark, d, "customer").select(F.col("c_custkey").alias("place"), (F.col("c_custkey") % 12 + 1).cast("int").alias("month"))
    cand = wanted.withColumn("r", F.explode(asof.month_ranks(F.col("month"), undated=True))).select(
        "place", "month", F.col("r.rank").alias("rank"), F.col("r.month").alias("chosen"))
    return asof.first_available(cand, present, ["place", "chosen"], ["place", "month"], "rank", "chosen").drop("rank")


@query("c19_element_time_grid", with_(ELE) + """, g as (
  select object_id, element_id, epoch_us, unnest(range(0, 5)) as k from ele),
t as (select object_id, (epoch_us - epoch_us % 3600000000 + 3600000000 * (k + 1))::bigint as t_us from g),
u as (select distinct object_id, t_us from t)
select u.object_id, u.t_us, e.element_id, e.epoch_us as matched_at from u asof left join ele e on u.object_id = e.object_id and u.t_us >= e.epoch_us""")
def c19(spark, d):
    el = A.elements(spark, d)
    start = timefn.floor_to("epoch_us", HOUR) + HOUR
    times = el.select("object_id", F.explode(F.sequence(start, start + 4 * HOUR, F.lit(HOUR))).alias("t_us")).distinct()
    return asof.asof_join(times, el, ["object_id"], "t_us", "epoch_us", ["element_id"], CHUNK_US, tie=["element_id"])


@query("c20_frame_of_time", """with f as (select (epoch_us(ts) - epoch_us(ts) % 3600000000)::bigint as f_us, min(value) as sun from events where event_type = 'signup' group by 1),
i as (select event_id, epoch_us(ts) as t_us from events where event_type = 'error')
select i.event_id, i.t_us, case when i.t_us - f.f_us <= 7200000000 then f.sun end as sun,
  case when i.t_us - f.f_us <= 7200000000 then f.f_us end as matched_at from i asof left join f on i.t_us >= f.f_us""")
def c20(spark, d):
    ev = A.events(spark, d)
    frames = ev.where("event_type = 'signup'").groupBy(timefn.floor_to("t_us", HOUR).alias("f_us")).agg(F.min("value").alias("sun"))
    seen = ev.where("event_type = 'error'").select("event_id", "t_us")
    return asof.latest_step(seen, frames, [], "t_us", "f_us", ["sun"], HOUR, 2 * HOUR)


@query("c21_near_storms", with_(BYTES) + """,
s as (select *, max(case when r > 190 then 1 else 0 end) over (partition by grid_id, y order by x rows between 4 preceding and 4 following) as mx,
  max(case when r > 200 then 1 else 0 end) over (partition by grid_id, y order by x rows between 8 preceding and 8 following) as nx from bytes),
t as (select *, max(mx) over (partition by grid_id, x order by y rows between 4 preceding and 4 following) as near4,
  max(nx) over (partition by grid_id, x order by y rows between 8 preceding and 8 following) as near8 from s)
select grid_id, y, x, near4 = 1 as near4, near8 = 1 as near8 from t""")
def c21(spark, d):
    flags = A.byte_cells(spark, d).selectExpr("grid_id", "y", "x", "case when r > 190 then 1 else 0 end as a",
                                              "case when r > 200 then 1 else 0 end as b")
    near = kernels.max_filter(flags, {"near": ("a", 9), "far": ("b", 17)}, A.H, A.W)
    return near.select("grid_id", "y", "x", (F.col("near") == 1).alias("near4"), (F.col("far") == 1).alias("near8"))


@query("c22_source_precedence", """with p as (select o_custkey % 700 as map, o_orderpriority as path from orders group by 1, 2
  having count(distinct case when o_orderkey % 3 in (0, 1, 2) then o_orderkey % 3 end) = 3),
r(path, rank) as (values ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4), ('5-LOW', 5))
select map, path, rank from p join r using (path) qualify row_number() over (partition by map order by rank) = 1""")
def c22(spark, d):
    """A source counts only with all three of its tails."""
    tails = A.table(spark, d, "orders").select(
        (F.col("o_custkey") % 700).alias("map"), F.col("o_orderpriority").alias("path"), (F.col("o_orderkey") % 3).alias("tail"))
    present = asof.complete(tails, ["map", "path"], "tail", [0, 1, 2])
    order = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(i + 1).alias("rank")) for i, p in enumerate(
        ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])])
    cand = present.select("map").distinct().select("map", F.inline(order))
    return asof.first_available(cand, present, ["map", "path"], ["map"], "rank", "path")
