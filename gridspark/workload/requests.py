"""Sorts, limits, top-k and set operations."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import numeric as N, physics, stars as S, timefn
from ..functions.solar import sun_vector
from ..operators import generations, requests as R
from ..operators.ordered import global_order
from ..plans import aurora, convection
from .aggregates import STORE, tile_store
from .registry import query
from .views import BYTES, GEN, IDX, REQ, STARS, TEL, r6, solar, with_

MERGED = """mg as (select layer, mip, y, x, max(priority) as priority, max(kind) as kind, max(frame) as frame from req group by 1, 2, 3, 4)"""


@query("f1_top_requests", with_(REQ) + """select layer, mip, y, x, count(*) as priority from req group by 1, 2, 3, 4
order by priority desc, layer, mip, y, x limit 16""")
def f1(spark, d):
    return R.top_requests(R.count_requests(A.requests(spark, d)), 16)


@query("f2_service_order", with_(REQ, MERGED) + "select *, row_number() over (order by kind desc, priority desc, layer, mip, y, x) as place from mg")
def f2(spark, d):
    return R.service_order(R.merge_requests(A.requests(spark, d))).withColumn("place", F.col("place").cast("bigint"))


@query("f3_catalogue_order", with_(STARS) + """, o as (select star_id, vmag, row_number() over (order by vmag desc, star_id) - 1 as i from stars)
select star_id, vmag, floor(i / 256)::int as row, (i % 256)::int as col from o""")
def f3(spark, d):
    out = global_order(A.stars(spark, d).select("star_id", "vmag"), [F.desc("vmag"), F.asc("star_id")], rank="i")
    i = F.col("i") - 1
    return out.select("star_id", "vmag", F.floor(i / 256).cast("int").alias("row"), (i % 256).cast("int").alias("col"))


@query("f4_strongest_storm", with_(BYTES) + """select grid_id, y, x, r * g * b as score from bytes where y between 40 and 119
qualify row_number() over (partition by grid_id order by r * g * b desc, y, x) = 1""")
def f4(spark, d):
    bands = A.byte_cells(spark, d).selectExpr("grid_id", "y", "x", "r as cloud", "g as cape", "b as rain")
    return convection.strongest_storm(bands, A.H)


NOON = 1_711_022_400_000_000


@query("f5_strongest_dark_aurora", with_(BYTES) + f""", c as (
  select grid_id, floor(y / 4)::int as cy, floor(x / 4)::int as cx, sum(a)::bigint as total from bytes group by 1, 2, 3),
s as (select dec, radians(-15e0 * (h - 12e0 + eqt / 60e0)) as lo from (select {solar(str(NOON))['dec']} as dec, {solar(str(NOON))['eqt']} as eqt, {solar(str(NOON))['hours']} as h) z),
p as (select c.*, 90e0 - (cy * 4 + 2) * 1.125e0 as lat, -180e0 + (cx * 4 + 2) * 1.8e0 as lon, dec, lo from c, s),
q as (select *, cos(radians(lat)) * cos(radians(lon)) * cos(dec) * cos(lo) + cos(radians(lat)) * sin(radians(lon)) * cos(dec) * sin(lo) + sin(radians(lat)) * sin(dec) as up from p)
select grid_id, lat, lon, round(total / 4080e0, 6) + 0e0 as probability from q
where abs(lat) between 45 and 85 and up <= -sin(radians(10e0)) qualify row_number() over (partition by grid_id order by total desc, cy, cx) = 1""")
def f5(spark, d):
    bands = A.byte_cells(spark, d).select("grid_id", "y", "x", "a")
    out = aurora.strongest_dark_cell(bands, "a", sun_vector(F.lit(NOON)), A.H, A.W)
    return out.select("grid_id", "lat", "lon", N.r6("probability").alias("probability"))


def gc(lat, lon, b, dist, name):
    return f"""asin(greatest(-1e0, least(1e0, sin({lat}) * cos({dist}) + cos({lat}) * sin({dist}) * cos({b})))) as {name}_lat,
      {lon} + atan2(sin({b}) * sin({dist}) * cos({lat}), cos({dist}) - sin({lat}) * greatest(-1e0, least(1e0, sin({lat}) * cos({dist}) + cos({lat}) * sin({dist}) * cos({b})))) as {name}_lon"""


@query("f6_aurora_vantage", f"""with t as (
  select event_id, case when event_id % 2 = 0 then 1 else -1 end * (50e0 + user_id % 30) as lat, value % 360e0 - 180e0 as lon, 5e0 + event_id % 10 as arc, epoch_us(ts) as t_us from events where event_type = 'error'),
s as (select event_id, radians(lat) as la, radians(lon) as lo, radians(arc) as d, {solar('t_us')['dec']} as dec,
  radians(-15e0 * ({solar('t_us')['hours']} - 12e0 + {solar('t_us')['eqt']} / 60e0)) as slo from t),
b as (select *, unnest(range(12)) as step from s),
c as (select *, radians(step * 30e0) as br, {gc('la', 'lo', 'radians(step * 30e0)', 'd', 'c')} from b),
h as (select *, atan2(sin(lo - c_lon) * cos(la), cos(c_lat) * sin(la) - sin(c_lat) * cos(la) * cos(lo - c_lon)) as heading from c),
o as (select h.*, radians(o.o) as off, radians(r.r) as reach from h, (values (-35e0), (-15e0), (0e0), (15e0), (35e0)) as o(o), (values (21e0), (26e0)) as r(r)),
p as (select *, {gc('c_lat', 'c_lon', '(heading + off)', 'reach', 'p')} from o),
w as (select event_id, step, la, c_lat, c_lon, heading, max(cos(p_lat) * cos(p_lon) * cos(dec) * cos(slo) + cos(p_lat) * sin(p_lon) * cos(dec) * sin(slo) + sin(p_lat) * sin(dec)) as worst from p group by all),
k as (select *, greatest(worst, -0.2e0) + 0.002e0 * degrees(abs(c_lat) - abs(la)) as score from w)
select event_id, step::int as step, round(score, 6) + 0e0 as score, round(degrees(c_lat), 6) + 0e0 as lat from k
qualify row_number() over (partition by event_id order by round(score, 9), step) = 1""")
def f6(spark, d):
    t = A.events(spark, d).where("event_type = 'error'").selectExpr(
        "event_id", "case when event_id % 2 = 0 then 1 else -1 end * (50e0 + user_id % 30) as lat",
        "value % 360e0 - 180e0 as lon", "5e0 + event_id % 10 as arc", "t_us")
    out = aurora.vantage(t.withColumn("sun", sun_vector("t_us")), "event_id")
    return out.select("event_id", "step", N.r6("score").alias("score"), N.r6("camera_lat").alias("lat"))


@query("f7_newest_object", """select user_id % 7 as product, max(epoch_us(ts)) as t_us, arg_max(event_id, ts) as object from events group by 1""")
def f7(spark, d):
    return A.events(spark, d).groupBy((F.col("user_id") % 7).alias("product")).agg(
        F.max("t_us").alias("t_us"), F.max_by("event_id", "t_us").alias("object"))


@query("g1_required_equals_found", with_(IDX) + """select file_id, bool_or(name = 'R') and bool_or(name = 'A') and bool_or(name = 'N') as complete from idx group by 1""")
def g1(spark, d):
    from ..operators.setops import same_set
    f = F.split("text", ":")
    found = A.index_lines(spark, d).select("file_id", f[3].alias("name"))
    return same_set(found, ["file_id"], "name", ["R", "A", "N"]).withColumnRenamed("same", "complete")


@query("g2_common_scenes", with_(TEL) + """select scene, wait from (select scene, floor(wait_ms)::int as wait from tel where run = 'before'
  intersect select scene, floor(wait_ms)::int from tel where run = 'after') q""")
def g2(spark, d):
    t = A.telemetry(spark, d).select("run", "scene", F.floor("wait_ms").cast("int").alias("wait"))
    return t.where("run = 'before'").drop("run").intersect(t.where("run = 'after'").drop("run"))


@query("g3_obsolete_generations", with_(GEN) + """,
g as (select product, gen_us, bool_or(file_id % 11 = 0) as preview, bool_and(name <> '5-LOW') as own, bool_or(name in ('1-URGENT', '2-HIGH')) as has from gen group by 1, 2),
r as (select product, gen_us, row_number() over (partition by product order by gen_us desc) as rank from (select distinct product, gen_us from gen where file_id % 11 <> 0) q)
select g.product, g.gen_us from g left join r on r.product = g.product and r.gen_us = g.gen_us
where (g.preview or coalesce(r.rank, 99) > 2) and own and has
  and not exists (select 1 from gen k where k.file_id % 17 = 0 and k.product = g.product and k.gen_us = g.gen_us)""")
def g3(spark, d):
    files = A.generation_files(spark, d).withColumn("preview", F.col("file_id") % 11 == 0).withColumn(
        "name", F.when(F.col("name").isin("1-URGENT", "2-HIGH"), "fields").when(F.col("name") == "5-LOW", "other").otherwise("clouds"))
    return generations.obsolete(files, files.where("file_id % 17 = 0"), ["fields", "clouds"], ["fields"])


@query("g4_eviction_plan", with_(STORE) + """,
c as (select s.*, sum(bytes) over (partition by store_id order by last_used, layer, mip, y, x) - bytes as before, sum(bytes) over (partition by store_id) as loose
  from store s where not pinned and 7000000000 - last_used >= 2000000),
g as (select *, case store_id when 1 then 400000 else 150000 end as shortage from c where store_id in (1, 2))
select store_id, y, x, bytes from g where before < shortage and loose >= shortage""")
def g4(spark, d):
    # One budget for all stores; what each store needs is set so that the shortage is a known number.
    store = tile_store(spark, d)
    used = store.groupBy("store_id").agg(F.sum("bytes").alias("_u"))
    budget = 1 << 40
    shortage = F.when(F.col("store_id") == 1, 400_000).when(F.col("store_id") == 2, 150_000).otherwise(0)
    need = used.select("store_id", (F.lit(budget) - F.col("_u") + shortage).alias("need_bytes"))
    _, evicted = R.plan_eviction(store, need, budget, 7_000_000_000)
    return evicted.select("store_id", "y", "x", "bytes")


@query("g4_eviction_verdicts", with_(STORE) + """,
u as (select store_id, sum(bytes)::bigint as resident, coalesce(sum(bytes) filter (not pinned and 3000000000 - last_used >= 2000000), 0)::bigint as loose from store group by 1),
n as (select *, case store_id when 0 then 20000000 when 1 then 3000000 else 5 end as need_bytes from u),
m as (select *, greatest(0, need_bytes - greatest(0, 12000000 - resident)) as missing from n)
select store_id, missing::bigint as missing, case when need_bytes > 12000000 then 'oversized' when missing = 0 then 'ready' when loose >= missing then 'evict' else 'deferred' end as verdict from m""")
def g4b(spark, d):
    store = tile_store(spark, d)
    need = store.select("store_id").distinct().withColumn(
        "need_bytes", F.when(F.col("store_id") == 0, 20_000_000).when(F.col("store_id") == 1, 3_000_000).otherwise(5))
    state, _ = R.plan_eviction(store, need, 12_000_000, 3_000_000_000)
    return state.select("store_id", F.col("missing").cast("bigint").alias("missing"), "verdict")


@query("g5_united_requests", with_(REQ) + """select layer, mip, y, x, count(*) as n, max(priority) as priority from (
  select layer, mip, y, x, priority from req where event_id % 2 = 0 union all select 2, mip, y, x, priority from req where event_id % 2 = 1
  union all select layer, mip + 1, y >> 1, x >> 1, priority from req where mip < 3) q group by 1, 2, 3, 4""")
def g5(spark, d):
    req = A.requests(spark, d)
    parents = req.where("mip < 3").select("layer", (F.col("mip") + 1).alias("mip"), F.shiftright("y", 1).alias("y"),
                                          F.shiftright("x", 1).alias("x"), "priority")
    one = req.where("event_id % 2 = 0").select(*R.KEY, "priority")
    two = req.where("event_id % 2 = 1").withColumn("layer", F.lit(2)).select(*R.KEY, "priority")
    return one.unionByName(two).unionByName(parents).groupBy(*R.KEY).agg(
        F.count(F.lit(1)).alias("n"), F.max("priority").alias("priority"))


@query("g6_hemisphere_union", with_(BYTES) + """select grid_id, y, x, r, 'nh' as side from bytes where 90e0 - (y + 0.5e0) * 1.125e0 > 35
union all select grid_id, y, x, r, 'sh' from bytes where 90e0 - (y + 0.5e0) * 1.125e0 < -35""")
def g6(spark, d):
    from ..functions.geo import row_lat
    cells = A.byte_cells(spark, d).select("grid_id", "y", "x", "r")
    lat = row_lat("y", A.H)
    return cells.where(lat > 35).withColumn("side", F.lit("nh")).unionByName(cells.where(lat < -35).withColumn("side", F.lit("sh")))


@query("g7_prefetch", with_(REQ) + """, s as (select layer, mip, y, x, priority, kind, frame from req
  union all select layer, mip - 1, y * 2 + dy, x * 2 + dx, floor(priority / 4)::int, 0, frame from req, (values (0), (1)) as a(dy), (values (0), (1)) as b(dx) where mip > 0)
select layer, mip, y, x, max(priority) as priority, max(kind) as kind, max(frame) as frame from s group by 1, 2, 3, 4""")
def g7(spark, d):
    return R.with_prefetch(A.requests(spark, d))
