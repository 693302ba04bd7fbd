"""Masks, gates and validation rules."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import geo, numeric as N, sky, solar, text
from ..operators import pyramid as P
from ..operators import requests as R
from ..operators.ordered import running
from ..plans import masks
from ..sources import manifests
from .registry import query
from .views import BYTES, CELLS, OBS, REQ, cosz, r6, step, with_


@query("b1_count_mask", with_(OBS) + """select event_id, product,
  case when cnt >= 0 and cnt <= 255 and not (product = 'LW' and cnt = 255) and not (product = 'VIS' and cnt = 0)
       then cnt end as cnt from obs""")
def b1(spark, d):
    return masks.mask_counts(A.observations(spark, d)).select("event_id", "product", "cnt")


@query("b2_unwrapped_axis", with_(CELLS) + """, ax as (
  select grid_id, x, max(case when x >= 190 then (x * 1.8e0 - 160e0) else x * 1.8e0 - 160e0 end) as lon from cells group by 1, 2),
u as (select grid_id, x, case when lon > 179.95e0 then lon - 360e0 else lon end as u from ax),
s as (select *, u - lag(u) over (partition by grid_id order by x) as du from u)
select grid_id, x, round(u, 6) + 0e0 as lon, coalesce(du > 0, true) as ascends from s""")
def b2(spark, d):
    axis = A.cells(spark, d).select("grid_id", "x").distinct().withColumn("lon", F.col("x") * 1.8 - 160.0)
    lon = geo.unwrap_lon("lon")
    out = masks.axis_steps(axis.withColumn("u", lon), ["grid_id"], "x", "u")
    return out.select("grid_id", "x", N.r6("u").alias("lon"), F.coalesce(F.col("step") > 0, F.lit(True)).alias("ascends"))


@query("b3_albedo", with_(OBS) + f""", c as (select event_id, cnt, {cosz('t_us', 'lat', 'lon')} as c from obs where product = 'VIS')
select event_id, {r6('c')} as cosine,
  case when c >= 0.1e0 then {r6('pow(cnt / 255e0, 2e0) / greatest(c, 0.12e0)')} end as albedo from c""")
def b3(spark, d):
    obs = A.observations(spark, d).where("product = 'VIS'").withColumn("c", solar.zenith_cosine("t_us", "lat", "lon"))
    return obs.select("event_id", N.r6("c").alias("cosine"), N.r6(solar.albedo("cnt", "c")).alias("albedo"))


@query("b4_water_by_colour", with_(BYTES) + """, h as (select grid_id, y, x, a as h from bytes where (x + y) % 5 <> 0)
select b.grid_id, b.y, b.x, coalesce((b.b > 1.35e0 * b.r and b.b > 1.08e0 * b.g) or h.h <= 40, false) as water
from bytes b left join h using (grid_id, y, x)""")
def b4(spark, d):
    cells = A.byte_cells(spark, d)
    height = cells.where("(x + y) % 5 <> 0").select("grid_id", "y", "x", F.col("a").alias("h"))
    joined = cells.join(height, ["grid_id", "y", "x"], "left")
    return joined.select("grid_id", "y", "x", masks.water_by_colour("r", "g", "b", "h", sea_level=40).alias("water"))


@query("b5_water_by_elevation", with_(BYTES) + """, e as (
  select *, case when x % 7 = 0 then null else a - 100 end as elev, case when (x + y) % 11 = 0 then 1 else 4 end as k from bytes),
q as (select grid_id, y, x, cast(floor(r / k / 3) as int) as r, cast(floor(g / k / 3) as int) as g, cast(floor(b / k) as int) as b, elev from e)
select grid_id, y, x, case when greatest(r, g, b) <= 24 and b >= r then true when elev is null then false
  else elev < -5 and not (r > 120 and r > b + 30) and not (r > 150 and g > 150 and b > 150) end as water from q""")
def b5(spark, d):
    q = A.byte_cells(spark, d).selectExpr(
        "grid_id", "y", "x", "case when x % 7 = 0 then null else a - 100 end as elev",
        "case when (x + y) % 11 = 0 then 1 else 4 end as k", "r", "g", "b").selectExpr(
        "grid_id", "y", "x", "elev", "cast(floor(r / k / 3) as int) as r", "cast(floor(g / k / 3) as int) as g",
        "cast(floor(b / k) as int) as b")
    return q.select("grid_id", "y", "x", masks.water_by_elevation("r", "g", "b", "elev").alias("water"))


@query("b6_latitude_bands", with_(OBS) + """select event_id, lat > 35 as north, lat < -35 as south, abs(lat) < 50 as tropics,
  abs(lat) between 45 and 85 as auroral from obs""")
def b6(spark, d):
    return A.observations(spark, d).select(
        "event_id", (F.col("lat") > 35).alias("north"), (F.col("lat") < -35).alias("south"),
        (F.abs("lat") < 50).alias("tropics"), geo.lat_band("lat", 45, 85).alias("auroral"))


@query("b7_element_checksum", """with l as (
  select event_id, rpad('1 ' || lpad(cast(user_id as varchar), 5, '0') || 'U -' || cast(cast(round(value * 100) as bigint) as varchar),
    68, '0-3') || cast(event_id % 10 as varchar) as line from events),
s as (select event_id, line, (
    (1 * (68 - strlen(replace(replace(line[1:68], '1', ''), '-', '')))
   + 2 * (68 - strlen(replace(line[1:68], '2', ''))) + 3 * (68 - strlen(replace(line[1:68], '3', '')))
   + 4 * (68 - strlen(replace(line[1:68], '4', ''))) + 5 * (68 - strlen(replace(line[1:68], '5', '')))
   + 6 * (68 - strlen(replace(line[1:68], '6', ''))) + 7 * (68 - strlen(replace(line[1:68], '7', '')))
   + 8 * (68 - strlen(replace(line[1:68], '8', ''))) + 9 * (68 - strlen(replace(line[1:68], '9', '')))) % 10) as c from l)
select event_id, cast(c as int) as checksum, c = event_id % 10 as valid from s""")
def b7(spark, d):
    lines = A.table(spark, d, "events").selectExpr("event_id", """concat(rpad(concat('1 ', lpad(cast(user_id as string), 5, '0'), 'U -',
        cast(cast(round(value * 100) as bigint) as string)), 68, '0-3'), cast(event_id % 10 as string)) as line""")
    return lines.select("event_id", text.element_checksum("line").cast("int").alias("checksum"),
                        text.element_line_ok("line").alias("valid"))


@query("b8_manifest_rules", """with m as (
  select doc_id, case when doc_id % 7 = 0 then 'OTHER' else 'NOAA-GFS' end as source, 'model-analysis' as kind,
    1440 as w, case when doc_id % 11 = 0 then 360 else 720 end as h, case when doc_id % 13 = 0 then 0 else doc_id + 1 end as t,
    case when doc_id % 5 = 0 then 'xyz' else sha256(text) end as sha, case when doc_id % 3 = 0 then 5 else 4147200 end as bytes
  from documents)
select doc_id, source = 'NOAA-GFS' and h = 720 and t > 0 and regexp_full_match(sha, '[0-9a-fA-F]{64}') and bytes = 4 * w * h as ok from m""")
def b8(spark, d):
    m = A.table(spark, d, "documents").selectExpr(
        "doc_id", "case when doc_id % 7 = 0 then 'OTHER' else 'NOAA-GFS' end as source", "'model-analysis' as kind",
        "1440 as w", "case when doc_id % 11 = 0 then 360 else 720 end as h",
        "case when doc_id % 13 = 0 then 0 else doc_id + 1 end as t",
        "case when doc_id % 5 = 0 then 'xyz' else sha2(text, 256) end as sha",
        "case when doc_id % 3 = 0 then 5 else 4147200 end as bytes")
    c = F.col
    return m.select("doc_id", manifests.manifest_ok(c("source"), c("kind"), c("w"), c("h"), c("t"), c("sha"), c("bytes")).alias("ok"))


SIDECAR = """with s as (
  select doc_id, case when doc_id % 31 = 0 then 2 else 1 end as schema_version, 'preview_texture' as asset,
    case when doc_id % 29 = 0 then 'rgba16' else 'bgra8' end as pixel_format,
    case when doc_id % 2 = 0 then 'srgb' else 'linear' end as color_space,
    case when doc_id % 23 = 0 then 'bottom_left' else 'top_left' end as origin,
    cast(n_chars as int) as width, cast(doc_id % 19 as int) as height,
    case when doc_id % 4 = 0 and doc_id % 17 <> 0 then 'linear-light-srgb-v1' when doc_id % 2 = 0 then null else 'x' end as rgb_filter,
    n_chars * 4 + case when doc_id % 37 = 0 then 1 else 0 end as row_stride_bytes,
    n_chars * 4 * (doc_id % 19) + case when doc_id % 41 = 0 then 1 else 0 end as payload_bytes
  from documents)
"""


@query("b9_sidecar_rules", SIDECAR + """select doc_id, case when schema_version <> 1 then 'version'
  when pixel_format <> 'bgra8' then 'pixel format' when origin <> 'top_left' then 'origin'
  when width <= 0 or height <= 0 then 'extent'
  when color_space = 'srgb' and rgb_filter is distinct from 'linear-light-srgb-v1' then 'filter'
  when row_stride_bytes <> width::bigint * 4 then 'stride'
  when payload_bytes <> width::bigint * 4 * height then 'payload size' else 'ok' end as rule from s""")
def b9(spark, d):
    A.table(spark, d, "documents").createOrReplaceTempView("documents_sidecar")
    s = spark.sql(SIDECAR.replace("from documents", "from documents_sidecar") + "select * from s")
    return s.select("doc_id", manifests.sidecar_rule(s, "preview_texture").alias("rule"))


@query("b10_mip_lists", """with s as (
  select c_custkey as k, case when c_custkey % 3 = 0 then 64 when c_custkey % 3 = 1 then 96 else 128 end as w,
    cast(c_custkey % 5 as int) as n, c_custkey % 7 = 0 as bad from customer),
m as (select k, w, n, bad, unnest(range(n)) as i from s),
l as (select k, w, n, bad, i, w >> i as mw, (w / 2)::int >> i as mh from m),
o as (select *, coalesce(sum((mw / 4) * (mh / 4) * 8) over (partition by k order by i
   rows between unbounded preceding and 1 preceding), 0) as off from l),
a as (select k, bool_and(mw % 4 = 0 and mh % 4 = 0) as blocks, bool_and(not (bad and i = 1)) as placed from o group by k)
select s.k, coalesce(a.blocks and a.placed and n >= 1, false) as ok from s left join a using (k)""")
def b10(spark, d):
    s = A.table(spark, d, "customer").selectExpr(
        "c_custkey as k", "case when c_custkey % 3 = 0 then 64 when c_custkey % 3 = 1 then 96 else 128 end as width",
        "cast(c_custkey % 5 as int) as n", "c_custkey % 7 = 0 as bad").selectExpr("*", "cast(width / 2 as int) as height")
    level = "named_struct('w', shiftright(width, i), 'h', shiftright(height, i))"
    s = s.selectExpr("*", f"transform(filter(sequence(0, 4), i -> i < n), i -> {level}) as lv")
    s = s.selectExpr("*", "transform(lv, m -> (m.w / 4) * (m.h / 4) * 8e0) as sizes")
    s = s.selectExpr("k", "width", "height", """transform(lv, (m, i) -> named_struct('w', m.w, 'h', m.h, 'offset',
        aggregate(slice(sizes, 1, i), 0e0, (a, v) -> a + v) + case when bad and i = 1 then 8 else 0 end)) as mips""",
        "aggregate(sizes, 0e0, (a, v) -> a + v) as payload_bytes")
    return P.mips_ok(s, "k", F.lit(8.0))


LAYERS = """ly as (
  select o_custkey as bundle, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as pos,
    o_orderkey, cast(o_orderkey % 12 as int) as ch, 256 << (o_orderkey % 3)::int as base_w, 256 as base_h from orders),
l2 as (
  select bundle, pos, cast(case when o_orderkey % 37 = 0 then 1 else pos * 2 end as int) as layer,
    case ch when 0 then 'day_color' when 1 then 'surface_normal' when 2 then 'night_emission' when 3 then 'water_mask'
      when 4 then 'cloud_density' when 5 then 'cloud_normal' when 6 then 'height' when 7 then 'star_panorama'
      when 8 then 'city_cloud_glow' when 9 then 'aurora_mask' when 10 then 'aurora_color' else 'lightning_mask' end as channel,
    case when o_orderkey % 41 = 0 then 'BC3' when ch in (0, 7, 8, 10) then 'BC7' when ch in (1, 5) then 'BC5' when ch = 6 then 'R16' else 'BC4' end as format,
    cast(case when o_orderkey % 43 = 0 then 3 else 9 + (o_orderkey % 3) end as int) as mip_count, base_w, base_h,
    case when o_orderkey % 47 = 0 then 8 else 5 end as flags, cast(o_orderkey % 3 as int) as e,
    cast(case when o_orderkey % 53 = 0 then 7 else 0 end as bigint) as shift from ly),
l3 as (select *, cast(case e when 0 then 9 when 1 then 11 else 15 end as bigint) as index_count from l2),
l4 as (select *, cast(coalesce(sum(index_count) over (partition by bundle order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as base_first from l3)"""


def layer_rows(spark, d):
    """Layer directories: one bundle per customer, a layer per order, some of them broken."""
    orders = A.table(spark, d, "orders").select(F.col("o_custkey").alias("bundle"), "o_orderkey")
    running(orders, ["bundle"], ["o_orderkey"], None, {"pos": ("count", F.lit(1))}).createOrReplaceTempView("numbered_orders")
    sql = LAYERS.replace(LAYERS[LAYERS.index("cast(row_number()"):LAYERS.index(" as pos,")], "cast(pos as int)").replace("o_custkey as bundle", "bundle")
    sql = sql.replace("from orders)", "from numbered_orders)").replace("256 << (o_orderkey % 3)::int", "shiftleft(256, cast(o_orderkey % 3 as int))")
    sql = sql.replace(LAYERS[LAYERS.index("cast(coalesce(sum(index_count)"):LAYERS.index(" as base_first")], "0L")
    layers = spark.sql(f"with {sql} select * from l4")
    out = running(layers.drop("base_first"), ["bundle"], ["pos"], 4096.0, {"base_first": ("sum", F.col("index_count"))}, inclusive=False)
    return out.withColumn("first_index", F.coalesce("base_first", F.lit(0)) + F.col("shift"))


@query("b11_layer_rules", "with " + LAYERS + """
select bundle, pos, case
  when layer <= lag(layer) over (partition by bundle order by pos) then 'ids must ascend'
  when mip_count <> 9 + e then 'incomplete mips'
  when format = 'BC3' then 'format not accepted' when flags = 8 then 'unknown flags'
  when shift <> 0 then 'index range not contiguous'
  when count(*) over (partition by bundle, channel) > 1 then 'channel repeated' else 'ok' end as rule from l4""")
def b11(spark, d):
    return P.audit_layers(layer_rows(spark, d), ["bundle"]).select("bundle", "pos", "rule")


INDEX = """ix as (
  select l_orderkey, l_linenumber, cast(l_orderkey % 3 as int) as layer,
    row_number() over (partition by l_orderkey % 3 order by l_orderkey, l_linenumber) - 1 as pos
  from (select distinct l_orderkey, l_linenumber from lineitem) q),
e as (
  select layer, cast(pos as bigint) as pos, 0 as mip, cast(case when pos % 97 = 5 then 3 else floor(pos / 128) end as int) as y,
    cast(pos % 128 as int) as x, case when pos % 101 = 0 then 4 else 0 end as flags,
    cast(pos * 34848 + 4096 + case when pos % 103 = 0 then 8 else 0 end as bigint) as payload_offset,
    cast(case when pos % 107 = 0 then 100 else 34848 end as bigint) as payload_bytes from ix)"""


@query("b12_index_rules", "with " + INDEX + """
select layer, pos, case when y >= 128 then 'outside its grid'
  when pos > 0 and (y, x) <= (lag(y) over w, lag(x) over w) then 'not in order'
  when flags <> 0 then 'unknown flags' when payload_offset % 16 <> 0 then 'not aligned'
  when payload_bytes <> 34848 then 'wrong size'
  when payload_offset + payload_bytes > 400000000 then 'beyond the file' else 'ok' end as rule
from e window w as (partition by layer order by pos)""")
def b12(spark, d):
    # Positions come from a ranked key, so no layer is numbered in one task.
    keys = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    numbered = running(keys.withColumn("layer", (F.col("l_orderkey") % 3).cast("int")), ["layer"],
                       ["l_orderkey", "l_linenumber"], None, {"pos": ("count", F.lit(1))}, inclusive=False)
    index = numbered.selectExpr(
        "layer", "pos", "0 as mip", "cast(case when pos % 97 = 5 then 3 else floor(pos / 128) end as int) as y",
        "cast(pos % 128 as int) as x", "case when pos % 101 = 0 then 4 else 0 end as flags",
        "cast(pos * 34848 + 4096 + case when pos % 103 = 0 then 8 else 0 end as bigint) as payload_offset",
        "cast(case when pos % 107 = 0 then 100 else 34848 end as bigint) as payload_bytes")
    layers = numbered.select("layer").distinct().withColumns({
        "base_w": F.lit(128 * 256), "base_h": F.lit(128 * 256), "mip_count": F.lit(16), "format": F.lit("BC4")})
    return P.audit_index(index, layers, 4096, 400_000_000).select("layer", "pos", "rule")


@query("b13_valid_requests", with_(REQ) + """select event_id, mip, y, x from req
where mip < 3 and x < cast(ceil(ceil(1600 / pow(2e0, mip)) / 256e0) as int) and y < cast(ceil(ceil(800 / pow(2e0, mip)) / 256e0) as int)""")
def b13(spark, d):
    layers = spark.createDataFrame([(1, 1600, 800, 4)], "layer int, base_w int, base_h int, mip_count int")
    return R.valid_requests(A.requests(spark, d), layers, 3).select("event_id", "mip", "y", "x")


@query("b14_night_gate", with_(OBS) + f""", c as (select event_id, {cosz('t_us', 'lat', 'lon')} as c from obs)
select event_id, {r6(step('-0.0872e0', '-0.342e0', 'c'))} as gate from c""")
def b14(spark, d):
    obs = A.observations(spark, d).withColumn("c", solar.zenith_cosine("t_us", "lat", "lon"))
    return obs.select("event_id", N.r6(sky.night_gate("c")).alias("gate"))


@query("b15_safe_names", """with n as (select page_id, case when page_id % 17 = 0 then '' when page_id % 19 = 0 then '.' || url
  when page_id % 3 = 0 then regexp_replace(url, '/', '', 'g') else url end as name from pages)
select page_id, case when name = '' then 'output' else regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') end as safe,
  name <> '' and not contains(name, '/') and not starts_with(name, '.') as confined from n""")
def b15(spark, d):
    n = A.table(spark, d, "pages").selectExpr("page_id", """case when page_id % 17 = 0 then '' when page_id % 19 = 0 then concat('.', url)
        when page_id % 3 = 0 then regexp_replace(url, '/', '') else url end as name""")
    return n.select("page_id", text.safe_name("name").alias("safe"), text.confined("name").alias("confined"))
