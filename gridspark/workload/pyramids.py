"""Pyramid bakes, audits and reports."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import numeric as N
from ..plans import audits, bake
from .kernels import NORMAL
from .predicates import LAYERS, layer_rows
from .registry import query
from .views import BYTES, CELLS, TEL, linear, spread, srgb, with_


def area_sql(n: int, m: int, name: str) -> str:
    r = f"({n}e0 / {m}e0)"
    return f"""{name} as (select t, s, (least((t + 1) * {r}, s + 1e0) - greatest(t * {r}, s)) / {r} as w, count(*) over (partition by t) as n from (
      select t, unnest(range(floor(t * {r})::int, ceil((t + 1) * {r})::int)) as s from (select unnest(range({m})) as t) a) b)"""


def gutter_sql(src: str, out: str, h: int, w: int, tile: int, g: int, unit: str, keys: str) -> str:
    return f"""{out}_y as (select t, l, greatest(0, least({h - 1}, t * {tile} + l - {g})) as y from (select unnest(range({-(-h // tile)})) as t) a, (select unnest(range({tile + 2 * g})) as l) b),
{out}_x as (select t, l, (t * {tile} + l - {g} + {w}) % {w} as x from (select unnest(range({-(-w // tile)})) as t) a, (select unnest(range({tile + 2 * g})) as l) b),
{out} as (select {keys}, a.t::int as ty, b.t::int as tx, sha256(unhex(string_agg({unit}, '' order by a.l, b.l))) as content_hash
  from {src} join {out}_y a using (y) join {out}_x b using (x) group by all)"""


TEXEL = "printf('%02X%02X%02X%02X', r, g, b, mask)"


@query("k10_day_pyramid", with_(BYTES) + f""", e as (select grid_id, y, x, r, g, b, case when x % 7 = 0 then null else a - 100 end as elev from bytes),
lt as (select grid_id, y, x, {linear('r')} as r, {linear('g')} as g, {linear('b')} as b,
  case when case when greatest(r, g, b) <= 24 and b >= r then true when elev is null then false
    else elev < -5 and not (r > 120 and r > b + 30) and not (r > 150 and g > 150 and b > 150) end then 255e0 else 0e0 end as mask from e),
{area_sql(160, 64, 'wy')}, {area_sql(200, 128, 'wx')},
a1 as (select grid_id, wy.t as y, x, {spread('r')} as r, {spread('g')} as g, {spread('b')} as b, {spread('mask')} as mask from lt join wy on y = s group by 1, 2, 3),
a2 as (select grid_id, y, wx.t as x, {spread('r')} as r, {spread('g')} as g, {spread('b')} as b, {spread('mask')} as mask from a1 join wx on x = s group by 1, 2, 3),
m0 as (select grid_id, 0 as mip, y, x, floor(round({srgb('r')} * 255e0, 6) + 0.5e0)::int as r, floor(round({srgb('g')} * 255e0, 6) + 0.5e0)::int as g,
  floor(round({srgb('b')} * 255e0, 6) + 0.5e0)::int as b, floor(round(mask, 6) + 0.5e0)::int as mask from a2),
m1 as (select grid_id, 1 as mip, y >> 1 as y, x >> 1 as x, floor({srgb('avg(' + linear('r') + ')')} * 255e0 + 0.5e0)::int as r, floor({srgb('avg(' + linear('g') + ')')} * 255e0 + 0.5e0)::int as g,
  floor({srgb('avg(' + linear('b') + ')')} * 255e0 + 0.5e0)::int as b, floor(avg(mask) + 0.5e0)::int as mask from m0 group by grid_id, y >> 1, x >> 1),
{gutter_sql('m0', 't0', 64, 128, 32, 4, TEXEL, 'grid_id, mip')}, {gutter_sql('m1', 't1', 32, 64, 32, 4, TEXEL, 'grid_id, mip')}
select * from t0 union all select * from t1""")
def k10(spark, d):
    frame = A.byte_cells(spark, d).selectExpr("grid_id", "y", "x", "r", "g", "b", "case when x % 7 = 0 then null else a - 100 end as elev")
    return bake.day_tiles(frame, (A.H, A.W), (64, 128), 32, 4).drop("payload")


RELIEF = f"""ev as (select grid_id, y, x, greatest(0e0, v * 9000e0) as h from cells),
{area_sql(160, 80, 'wy')}, {area_sql(200, 100, 'wx')},
a1 as (select grid_id, wy.t as y, x, {spread('h')} as h from ev join wy on y = s group by 1, 2, 3),
a2 as (select grid_id, y, wx.t as x, {spread('h')} as h from a1 join wx on x = s group by 1, 2, 3),
nb as (select c.grid_id, c.y, c.x, c.h, e.h as e, w.h as w, s.h as s, n.h as n from a2 c
  left join a2 e on e.grid_id = c.grid_id and e.y = c.y and e.x = (c.x + 1) % 100 left join a2 w on w.grid_id = c.grid_id and w.y = c.y and w.x = (c.x + 99) % 100
  left join a2 s on s.grid_id = c.grid_id and s.x = c.x and s.y = c.y + 1 left join a2 n on n.grid_id = c.grid_id and n.x = c.x and n.y = c.y - 1),
g as (select grid_id, y, x, 40e0 * (e - w) / (2 * greatest(100e0, 6378137e0 * cos(radians(90e0 - (y + 0.5e0) * 2.25e0)) * 2 * pi() / 100)) as dx,
  40e0 * (coalesce(n, h) - coalesce(s, h)) / ((case when s is null then 0 else 1 end + case when n is null then 0 else 1 end) * 6378137e0 * pi() / 80) as dy from nb),
m0 as (select grid_id, y, x, floor(round((-dx / sqrt(dx * dx + dy * dy + 1) * 0.5e0 + 0.5e0) * 255e0, 6) + 0.5e0)::int as nx,
  floor(round((-dy / sqrt(dx * dx + dy * dy + 1) * 0.5e0 + 0.5e0) * 255e0, 6) + 0.5e0)::int as ny from g)"""


@query("k11_relief_pyramid", with_(CELLS, RELIEF, *[
    f"m{k} as (select grid_id, y >> 1 as y, x >> 1 as x, floor(avg(nx) + 0.5e0)::int as nx, floor(avg(ny) + 0.5e0)::int as ny from m{k - 1} group by 1, 2, 3)"
    for k in range(1, 8)]) + " union all ".join(f"select grid_id, {k} as mip, y::int as y, x::int as x, nx, ny from m{k}" for k in range(8)))
def k11(spark, d):
    frame = A.cells(spark, d).select("grid_id", "y", "x", (F.col("v") * 9000.0).alias("elev"))
    return bake.relief_levels(frame, (A.H, A.W), (80, 100), exaggeration=40.0)


@query("k12_retiled_layers", with_(BYTES) + f""", l as (select grid_id, 1 as layer, y, x, r as v from bytes union all select grid_id, 2, y, x, g from bytes union all select grid_id, 3, y, x, b from bytes),
bl as (select grid_id, layer, floor(y / 4)::int as y, floor(x / 4)::int as x, string_agg(printf('%02X', v), '' order by y % 4, x % 4) as code
  from (select grid_id, layer, y::int as y, x::int as x, v from l where layer < 3 or y % 4 < 2) q group by grid_id, layer, floor(y / 4)::int, floor(x / 4)::int),
{gutter_sql('bl', 't', 40, 50, 8, 1, 'code', 'grid_id, layer')} select *, 0 as mip from t""")
def k12(spark, d):
    """Two layers of blocks of 16 bytes and one of 8, as stored rows, cut into tiles of 8 blocks with a gutter of one."""
    rows = bake.block_rows(A.byte_cells(spark, d), {1: ("r", 16), 2: ("g", 16), 3: ("b", 8)}, A.H, A.W)
    return bake.retile_blocks(rows, 8, 1).drop("payload")


@query("k14_bundle_audit", "with " + LAYERS + """,
bad as (select bundle, count(*) filter (rule <> 'ok') as bad_layers from (select bundle, case
  when layer <= lag(layer) over (partition by bundle order by pos) then 'ids must ascend' when mip_count <> 9 + e then 'incomplete mips'
  when format = 'BC3' then 'f' when flags = 8 then 'u' when shift <> 0 then 'i'
  when count(*) over (partition by bundle, channel) > 1 then 'channel repeated' else 'ok' end as rule from l4) q group by 1),
mis as (select bundle, 12 - count(distinct channel) as missing from l4 group by 1),
f as (select doc_id as name, sha256(text) as h from documents), x as (
  select case when doc_id % 103 = 0 then -doc_id else doc_id end as name, sha256(case when doc_id % 97 = 0 then text || 'x' else text end) as h from documents where doc_id % 101 <> 0),
v as (select abs(coalesce(f.name, x.name)) % 1500 as bundle, count(*) filter (f.h is distinct from x.h) as bad_files from f full outer join x on f.name = x.name group by 1)
select bundle, missing, bad_layers, coalesce(bad_files, 0) as bad_files, missing = 0 and bad_layers = 0 and coalesce(bad_files, 0) = 0 as ok
from bad join mis using (bundle) left join v using (bundle)""")
def k14(spark, d):
    def owned(df):
        return df.withColumn("bundle", F.abs("name") % 1500)
    return audits.audit_bundles(layer_rows(spark, d), owned(A.assets(spark, d)), owned(A.expected_assets(spark, d)))


@query("k15_comparison_report", with_(TEL) + """, s as (select scene, median(wait_ms) filter (run = 'before') as b, median(wait_ms) filter (run = 'after') as a,
  count(*) filter (run = 'before') as before_samples, count(*) filter (run = 'after') as after_samples from tel group by 1)
select scene, before_samples, after_samples, round(b, 6) + 0e0 as before_median, round(a, 6) + 0e0 as after_median, round((1 - a / b) * 100, 6) + 0e0 as reduction from s""")
def k15(spark, d):
    out = audits.comparison_report(A.telemetry(spark, d), "wait_ms")
    return out.select("scene", "before_samples", "after_samples", *[N.r6(c).alias(c) for c in ("before_median", "after_median", "reduction")])
