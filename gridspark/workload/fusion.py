"""The observation and model compositions."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import numeric as N, physics
from ..functions.timefn import HOUR_US
from ..operators import kernels as K, seams
from ..operators.regrid import block_mean
from ..plans import aurora, clouds, composites, convection, model
from ..sources import message_index
from .aggregates import CUBIC, kernel_sql
from .kernels import blur_sql, dilate_sql
from .registry import query
from .scalars import oval_sql, storm_oval
from .views import BYTES, CELLS, OBS, SKY, clip, cosz, r6, spread, step, with_

COMPOSITES = f"""m as (select (t_us - t_us % 3600000000)::bigint as run_us, y, x, lat, lon,
    min(cnt) filter (product = 'VIS' and cnt > 0 and cnt <= 255) as vis, min(cnt) filter (product = 'LW' and cnt >= 0 and cnt < 255) as ir
  from obs group by 1, 2, 3, 4, 5),
f0 as (select *, {cosz('(run_us + 300000000)', 'lat', 'lon')} as c from m),
f as (select run_us, y, x, c, lat, ir, c > 0.1e0 as is_day, case when c >= 0.1e0 then pow(vis / 255e0, 2e0) / greatest(c, 0.12e0) end as albedo from f0),
r0 as (select run_us, least(72e0, greatest(0e0, (run_us - lag(run_us) over (order by run_us)) / 3.6e9)) as h from (select distinct run_us from f) q),
r as (select run_us, sum(coalesce(h, 0)) over (order by run_us) as u from r0),
k as (select f.*, u, 0.004e0 * u + min(albedo - 0.004e0 * u) over w as vis_clear,
    0.6e0 * u + min(case when is_day then ir - 0.6e0 * u end) over w as ir_day,
    0.6e0 * u + min(case when not is_day then ir - 0.6e0 * u end) over w as ir_night
  from f join r using (run_us) window w as (partition by y, x order by run_us))"""

CLOUDY_SHARE = with_(OBS, COMPOSITES) + f""", q as (select *, coalesce({step('0.02e0', '0.45e0', 'albedo - coalesce(least(vis_clear, 0.45e0), 0.12e0)')}, {step('16e0', '60e0', 'ir - coalesce(ir_night, ir_day)')}) as cloud from k)
select run_us, floor(y / 2)::int as by, floor(x / 3)::int as bx, count(*) as n, round(avg(case when cloud > 0.5e0 then 1e0 else 0e0 end), 6) + 0e0 as share,
  round(avg(cloud), 6) + 0e0 as mean_cloud from q where cloud is not null group by 1, 2, 3"""


@query("k0_cloudy_share_per_hour", CLOUDY_SHARE)
def k0(spark, d):
    return composites.cloudy_share(A.observations(spark, d))


@query("k1_clear_sky_composites", with_(OBS, COMPOSITES) + """select run_us, y, x, round(vis_clear, 6) + 0e0 as vis_clear,
  round(ir_day, 6) + 0e0 as ir_day, round(ir_night, 6) + 0e0 as ir_night from k""")
def k1(spark, d):
    out = composites.composites(composites.hourly_fields(A.observations(spark, d)))
    return out.select("run_us", "y", "x", *[N.r6(c).alias(c) for c in ("vis_clear", "ir_day", "ir_night")])


def balance_sql(src: str, band: str, out: str) -> str:
    """The seam balance of one band of ``src`` as a chain ending in ``out``."""
    return f"""nom(seam, c) as (values (0, 1), (1, 41), (2, 79), (3, 113), (4, 152)),
cand as (select seam, c, o, (c + o - 3 + 200) % 200 as x from nom, (select unnest(range(7)) as o) o),
jmp as (select a.grid_id, seam, c, o, cand.x, case when count(a.{band} - b.{band}) >= 60 then median(abs(a.{band} - b.{band})) else 0 end as jump
  from cand join {src} a on a.x = cand.x join {src} b on b.x = (cand.x + 199) % 200 and b.y = a.y and b.grid_id = a.grid_id group by 1, 2, 3, 4, 5),
st as (select grid_id, seam, case when jump > 0 then x else c end as c0 from jmp qualify row_number() over (partition by grid_id, seam order by jump desc, o) = 1),
sides as (select grid_id, seam, unnest(range(4)) as k, 1 as east, c0 from st union all select grid_id, seam, unnest(range(4)), 0, c0 from st),
stp as (select s.grid_id, seam, y, case when count({band}) filter (east = 1) >= 2 then avg({band}) filter (east = 1) end
    - case when count({band}) filter (east = 0) >= 2 then avg({band}) filter (east = 0) end as step
  from {src} s join sides q on q.grid_id = s.grid_id and s.x = (case when east = 1 then c0 + 2 + k else c0 - 3 - k + 200 end) % 200 group by 1, 2, 3),
med as (select grid_id, seam, y, case when count(step) over w >= 3 then greatest(-0.5e0, least(0.5e0, quantile_cont(step, 0.5) over w)) else 0 end as o
  from stp window w as (partition by grid_id, seam order by y rows between 1 preceding and 1 following)),
kk as (select unnest(range(11)) as k),
cor as (select grid_id, y, ((c0 + kk.k) % 200) as x, greatest(o, 0) * 0.5e0 * (1 + cos(pi() * (kk.k + 0.5e0) / 11)) as c from med join st using (grid_id, seam), kk
  union all select grid_id, y, ((c0 - 1 - kk.k + 200) % 200), greatest(-o, 0) * 0.5e0 * (1 + cos(pi() * (kk.k + 0.5e0) / 11)) from med join st using (grid_id, seam), kk),
csum as (select grid_id, y, x, sum(c) as c from cor group by 1, 2, 3),
{out} as (select s.* replace (s.{band} - coalesce(q.c, 0) as {band}) from {src} s left join csum q using (grid_id, y, x))"""


EXCESS = "ex as (select *, albedo - coalesce(least(vis_clear, 0.45e0), 0.12e0) as excess from sky)"


@query("k3_seam_balance", with_(SKY, EXCESS, balance_sql("ex", "excess", "bal")) + "select grid_id, y, x, round(excess, 6) + 0e0 as excess from bal")
def k3(spark, d):
    sky = A.sky_cells(spark, d)
    ex = sky.select("grid_id", "y", "x", (F.col("albedo") - F.coalesce(F.least(F.col("vis_clear"), F.lit(0.45)), F.lit(0.12))).alias("excess"))
    return seams.balance(ex, "excess", A.H, A.W).withColumn("excess", N.r6("excess"))


LOW_MODEL = """lo0 as (select grid_id, floor(y / 8)::int as y, floor(x / 8)::int as x, round_even(greatest(0e0, least(1e0, avg(model))) * 255e0, 0) as model,
  round_even(greatest(0e0, least(1e0, avg(low))) * 255e0, 0) as low from sky group by 1, 2, 3)"""
UP = kernel_sql(20, 160, "uy", "y", 2, CUBIC) + ", " + kernel_sql(25, 200, "ux", "x", 2, CUBIC) + f""",
up1 as (select grid_id, uy.t as y, x, {spread('model')} as model, {spread('low')} as low from lo0 join uy on y = s group by 1, 2, 3),
up2 as (select grid_id, y::int as y, ux.t::int as x, {spread('model')} as model, {spread('low')} as low from up1 join ux on x = s group by 1, 2, 3),
up as (select grid_id, y, x, floor(round({clip('model', '0e0', '255e0')}, 6) + 0.5e0) / 255e0 as gfs, floor(round({clip('low', '0e0', '255e0')}, 6) + 0.5e0) / 255e0 as lowc from up2)"""
COVER = f"""src as (select grid_id, y, x, case when ir is null then 255e0 else 0e0 end as v from sky),
{blur_sql('src', 28.0)},
cv0 as (select bal.*, gfs, coalesce(lowc, gfs) as lowc, abs(90e0 - (y + 0.5e0) * 1.125e0) as alat, floor(round(greatest(0e0, least(255e0, by2.v)), 6) + 0.5e0) / 255e0 as feather
  from bal join by2 using (grid_id, y, x) left join up using (grid_id, y, x)),
cv1 as (select *, {step('0.02e0', '0.45e0', 'excess')} as vis, {step('0.10e0', '0.34e0', 'cosine')} as dayw,
  coalesce(ir_night, ir_day, 65e0 + 60e0 * pow(alat / 72e0, 2e0)) as cold from cv0),
cv2 as (select *, coalesce(ir_day, cold) as warm from cv1),
cv3 as (select *, coalesce(greatest({step('16e0', '60e0', 'ir - cold')}, dayw * coalesce({step('0e0', '0.02e0', 'excess')}, 0) * {step('16e0', '60e0', 'ir - warm')}), 0) as infra from cv2),
cv4 as (select *, dayw * case when vis is not null then greatest(vis, 0.85e0 * infra) else infra end + (1 - dayw) * greatest(infra, 0.8e0 * lowc) as seen,
  greatest(case when ir is null then 1e0 else 0e0 end, least(1e0, 2 * feather)) as fill from cv3),
cv as (select grid_id, y, x, ir, cold, case when gfs is null then case when ir is not null then seen end else {step('72.7e0', '70.5e0', 'alat')} * (fill * gfs + (1 - fill) * seen) + (1 - {step('72.7e0', '70.5e0', 'alat')}) * gfs end as cover,
  case when ir is null then 0.3e0 * gfs else {step('90e0', '215e0', 'ir')} end as coldness from cv4)"""
COVER_VIEWS = (SKY, EXCESS, balance_sql("ex", "excess", "bal"), LOW_MODEL, UP, COVER)


PARTIAL = COVER.replace("left join up using (grid_id, y, x)", """left join (
    select grid_id, y, x, case when x < 150 then gfs end as gfs, case when x < 100 then lowc end as lowc from up where y < 140) up using (grid_id, y, x)""")


def cloud_cells(spark, d, partial: bool = False):
    sky = A.sky_cells(spark, d)
    coarse = block_mean(sky, ["model", "low"], 8, A.H, A.W)
    up = clouds.upsample(coarse, ["model", "low"], (20, 25), (A.H, A.W))
    if partial:
        up = up.where("y < 140").select("grid_id", "y", "x", F.when(F.col("x") < 150, F.col("model")).alias("model"),
                                        F.when(F.col("x") < 100, F.col("low")).alias("low"))
    return clouds.cloud_cover(sky.drop("model", "low"), up, A.H, A.W)


@query("k2_cloud_cover", with_(*COVER_VIEWS) + "select grid_id, y, x, round(cover, 6) + 0e0 as cover, round(coldness, 6) + 0e0 as coldness, ir is null as missing from cv")
def k2(spark, d):
    return cloud_cells(spark, d).select("grid_id", "y", "x", N.r6("cover").alias("cover"), N.r6("coldness").alias("coldness"), "missing")


@query("k2_cover_with_gaps_in_the_model", with_(*COVER_VIEWS[:-1], PARTIAL) + "select grid_id, y, x, round(cover, 6) + 0e0 as cover, round(coldness, 6) + 0e0 as coldness, ir is null as missing from cv")
def k2b(spark, d):
    """Sources that may fail: no model in the last rows and columns, and no low cloud in half of the columns."""
    return cloud_cells(spark, d, partial=True).select("grid_id", "y", "x", N.r6("cover").alias("cover"), N.r6("coldness").alias("coldness"), "missing")


CONVECTION = f"""th as (select grid_id, greatest(175e0, quantile_cont(ir, 0.99)) as th from sky where abs(90e0 - (y + 0.5e0) * 1.125e0) < 50 and ir is not null group by 1),
cold0 as (select grid_id, y, x, ir, coalesce(ir_night, ir_day, 65e0 + 60e0 * pow(abs(90e0 - (y + 0.5e0) * 1.125e0) / 72e0, 2e0)) as cold from sky),
cq as (select c.grid_id, y, x, round_even(255e0 * case when abs(90e0 - (y + 0.5e0) * 1.125e0) < 50 then coalesce({step('th - 8', 'th + 4', 'ir')}, 0) * coalesce({step('30e0', '60e0', 'ir - cold')}, 0) else 0 end, 0) as q from cold0 c left join th using (grid_id)),
cb as (select grid_id, y >> 1 as y, x >> 1 as x, floor(avg(q) + 0.5e0) / 255e0 as conv from cq group by 1, 2, 3)"""


def convection_cells(spark, d):
    sky = A.sky_cells(spark, d)
    lat = F.abs(90.0 - (F.col("y") + 0.5) * (180.0 / A.H))
    sky = sky.withColumn("ir_cold", F.coalesce("ir_night", "ir_day", 65.0 + 60.0 * F.pow(lat / 72.0, F.lit(2.0))))
    return convection.deep_convection(sky, A.H, A.W, (A.H // 2, A.W // 2))


@query("k4_deep_convection", with_(SKY, CONVECTION) + "select grid_id, y, x, round(conv, 6) + 0e0 as conv from cb")
def k4(spark, d):
    return convection_cells(spark, d).withColumn("conv", N.r6("conv"))


@query("k5_storm_steering", with_(SKY, CONVECTION) + f""", pk as (
  select grid_id, (y // 2)::int as y, (x // 2)::int as x, round_even(avg(r), 0)::int as cloud, round_even(avg(g), 0)::int as cape, round_even(avg(b), 0)::int as rain from (
    select grid_id, y, x, r, (r * 3 + x) % 256 as g, (r * 5 + y) % 256 as b from (
      select grid_id, y, x, cast(least(255e0, greatest(0e0, round_even((v + 1e0) * 127.5e0, 0))) as int) as r from cells) q) z group by 1, 2, 3),
n1 as (select p.*, conv, round_even(conv * 255, 0) as top, max(cape) over (partition by p.grid_id, y order by x rows between 4 preceding and 4 following) as c1 from pk p join cb using (grid_id, y, x)),
n2 as (select *, max(c1) over (partition by grid_id, x order by y rows between 4 preceding and 4 following) as ncape, max(top) over (partition by grid_id, y order by x rows between 8 preceding and 8 following) as t1 from n1),
n3 as (select *, max(t1) over (partition by grid_id, x order by y rows between 8 preceding and 8 following) / 255e0 as ntop from n2),
s as (select *, greatest(0e0, least(1e0, conv * {step('5e0', '25e0', 'ncape')})) as storm, rain * (0.25e0 + 0.75e0 * {step('0.05e0', '0.3e0', 'ntop')}) as dry from n3)
select grid_id, y, x, round_even(greatest(cloud, storm * 0.85e0 * 255), 0)::int as cloud, round_even(greatest(cape, storm * 0.4e0 * 255), 0)::int as cape,
  round_even(greatest(dry, storm * 0.55e0 * 255), 0)::int as rain from s""")
def k5(spark, d):
    half = block_mean(A.byte_cells(spark, d), ["r", "g", "b"], 2, A.H, A.W)
    packed = half.select("grid_id", "y", "x", *[F.rint(c).cast("int").alias(n) for c, n in (("r", "cloud"), ("g", "cape"), ("b", "rain"))])
    return convection.steer_storms(packed, convection_cells(spark, d), A.H // 2, A.W // 2)


@query("k6_model_packing", with_(SKY) + f""", c0 as (select grid_id, y, x, round_even(255e0 * {clip('model', '0e0', '1e0')} * (1 - exp(-75e0 * greatest(low / 20, 0e0))), 0) as v from sky),
src as (select grid_id, y, x + t * 200 as x, v from c0, (values (0), (1), (-1)) as q(t) where x + t * 200 between -3 and 202),
{blur_sql('src', 0.7, 3)}
select s.grid_id, s.y, s.x, floor(round(b.v, 6) + 0.5e0)::int as cloud, round_even(255e0 * {clip('low', '0e0', '1e0')}, 0)::int as cape,
  round_even(255e0 * {clip('ln(1 + 3600e0 * greatest(low / 100, 0e0)) / ln(51e0)', '0e0', '1e0')}, 0)::int as rain from sky s join by2 b using (grid_id, y, x)""")
def k6(spark, d):
    fields = A.sky_cells(spark, d).selectExpr("grid_id", "y", "x", "model * 100 as cloud_pct", "low / 20 as water", "low * 4000 as cape", "low / 100 as rain")
    return model.pack_model(fields, A.H, A.W)


@query("k7_aerosol", with_(SKY) + """, a as (select grid_id, y, x, greatest(0e0, least(4e0, model * 3)) as tau,
  greatest(-0.5e0, least(2.5e0, -ln(greatest(model, 1e-4) / greatest(low, 1e-4)) / ln(440e0 / 645e0))) as al from sky)
select grid_id, y, x, round_even(255e0 * least(1e0, (al + 0.5e0) / 3e0), 0)::int as blue, round_even(255e0 * sqrt(tau / 4e0), 0)::int as alpha from a""")
def k7(spark, d):
    depths = A.sky_cells(spark, d).selectExpr("grid_id", "y", "x", "model as aod440", "model * 3 as aod550", "low as aod645")
    f = model.aerosol_field(depths)
    return f.select("grid_id", "y", "x", N.rint255(physics.angstrom_fraction("angstrom")).alias("blue"),
                    N.rint255(physics.depth_fraction("tau")).alias("alpha"))


ICE = {"a_km": 6378.273, "b_km": 6356.889449, "lat_ts": 70.0, "lon_0": -45.0, "origin": (-5000.0, 50.0, 4000.0, -50.0)}


@query("k7_sea_ice", with_(CELLS) + """, h0 as (select grid_id, y, x, case when v < -0.05e0 then null else abs(v) * 1.5e0 end as v from cells),
""" + ",\n".join(dilate_sql(k) for k in range(4)) + """,
pts as (select grid_id, y::int as y, x::int as x, 90e0 - (y + 0.5e0) * 2 as lat, -180e0 + (x + 0.5e0) * 2 as lon from (select distinct grid_id from cells) g, (select unnest(range(90)) as y) a, (select unnest(range(180)) as x) b),
pr as (select *, case when lat > 0 then 1e0 else -1e0 end as s, sqrt(1e0 - pow(6356.889449e0 / 6378.273e0, 2e0)) as e from pts where abs(lat) > 35),
t as (select *, radians(lat) * s as phi, radians(lon + 45e0) * s as lam from pr),
k as (select *, 6378.273e0 * (cos(radians(70e0)) / sqrt(1e0 - e * e * sin(radians(70e0)) * sin(radians(70e0))))
   * (tan(pi() / 4 - phi / 2) / pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2))
   / (tan(pi() / 4 - radians(70e0) / 2) / pow((1 - e * sin(radians(70e0))) / (1 + e * sin(radians(70e0))), e / 2)) as rho from t),
q as (select grid_id, y, x, round_even((s * rho * sin(lam) + 5000e0) / 50e0, 0) as sx, round_even((-s * rho * cos(lam) - 4000e0) / -50e0, 0) as sy from k)
select q.grid_id, q.y, q.x, round(greatest(0e0, least(1e0, coalesce(h.v, 0e0))), 6) + 0e0 as ice from q left join h4 h on h.grid_id = q.grid_id and h.x = sx and h.y = sy""")
def k7b(spark, d):
    cells = A.cells(spark, d)
    raw = cells.select("grid_id", "y", "x", F.when(F.col("v") < -0.05, -1.0).otherwise(F.abs("v") * 15000.0).alias("raw"))
    grids = cells.select("grid_id").distinct().select("grid_id", F.col("grid_id").alias("target_id"), F.explode(F.array(F.lit(True), F.lit(False))).alias("north"))
    return model.sea_ice_field(raw, grids, (A.H, A.W), (90, 180), ICE).withColumn("ice", N.r6("ice"))


LINEAR = "greatest(0e0, 1 - q)"


@query("k8_aurora_grid", with_(BYTES) + """, p as (select grid_id, y, (x + 100) % 200 as x, floor(r * 100 / 255e0) / 100e0 as v from bytes where (x + y) % 7 <> 0 union all select distinct grid_id, yy.y, xx.x, 0e0 from bytes, (select unnest(range(160)) as y) yy, (select unnest(range(200)) as x) xx),
""" + kernel_sql(160, 320, "wy", "y", 1, LINEAR) + ", " + kernel_sql(200, 400, "wx", "x", 1, LINEAR) + """,
a as (select grid_id, wy.t as y, x, sum(v * w) as v from p join wy on y = s group by 1, 2, 3)
select grid_id, y::int as y, wx.t::int as x, round_even(round(sum(v * w) * 255e0, 6), 0)::int as alpha from a join wx on x = s group by 1, 2, 3""")
def k8(spark, d):
    points = A.byte_cells(spark, d).selectExpr("grid_id", "x as lon", "79 - y as lat", "case when (x + y) % 7 <> 0 then floor(r * 100 / 255e0) end as value")
    return aurora.aurora_grid(points, "grid_id", (160, 200), (320, 400))


@query("k9_retained_observations", """select doc_id as record, epoch_base + doc_id * 1000000 as clouds_us from (select *, 1700000000000000::bigint as epoch_base from documents) d
where doc_id % 5 <> 0 and doc_id % 6 not in (0, 1) and doc_id % 13 <> 0 and doc_id % 7 <> 0 and doc_id % 9 <> 0""")
def k9(spark, d):
    docs = A.table(spark, d, "documents")
    base = "1700000000000000 + doc_id * 1000000"
    records = docs.selectExpr(
        "doc_id as record", "case when doc_id % 5 = 0 then 3 else 4 end as packing_version", f"{base} as clouds_us",
        f"{base} + case when doc_id % 6 = 0 then 6 when doc_id % 6 = 1 then -7 else 5 end * 3600000000 as now_us",
        "concat('gen/', doc_id, '.bgra') as name", "sha2(text, 256) as sha256", "n_chars as bytes")
    payloads = docs.where("doc_id % 7 <> 0").selectExpr(
        "concat('gen/', doc_id, '.bgra') as name", "sha2(case when doc_id % 13 = 0 then concat(text, 'x') else text end, 256) as sha256", "n_chars as bytes")
    sidecars = docs.where("doc_id % 9 <> 0").selectExpr("concat('gen/', doc_id, '.bgra.json') as name", "'' as sha256", "1L as bytes")
    return model.retained_observation(records, payloads.unionByName(sidecars)).select("record", "clouds_us")


@query("k18_synthetic_override", with_(BYTES) + ", " + oval_sql()[5:].rsplit("select grid_id, y, x, round_even", 1)[0] + """, ov as (select grid_id, y, x, round_even""" +
       oval_sql().rsplit("select grid_id, y, x, round_even", 1)[1] + """)
select b.grid_id, b.y, b.x, b.r, b.g, b.b, ov.p as a, 'SYNTHETIC storm preview (not an observation)' as source from bytes b join ov using (grid_id, y, x)""")
def k18(spark, d):
    return model.synthetic_override(A.byte_cells(spark, d), storm_oval(spark, d), "a", "storm preview")
