"""Scans, sources and sinks."""

import uuid

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.text import element_line_ok
from ..operators import pyramid as P
from ..operators.asof import latest_complete_cycle
from ..session import checkpoint_root
from ..sinks import generations, packed, provenance
from ..sources import catalogues, manifests, message_index, products, rasters, telemetry
from .registry import query
from .views import BYTES, CELLS, GEN, IDX, STARS, with_

WANTED = [("R", "surface", "rain"), ("A", "surface", "area"), ("N", "surface", "night")]


@query("a1_message_ranges", with_(IDX) + """, nxt as (
  select *, lead(start_byte) over (partition by file_id order by line_no) - 1 as end_byte from idx),
hit as (
  select *, row_number() over (partition by file_id, name order by line_no desc) as rn
  from nxt where end_byte is not null)
select file_id, case name when 'R' then 'rain' when 'A' then 'area' else 'night' end as name, start_byte, end_byte
from hit where rn = 1 and file_id in (select file_id from hit where rn = 1 group by file_id having count(*) = 3)""")
def a1(spark, d):
    return message_index.message_ranges(A.index_lines(spark, d), WANTED)


@query("a2_aerosol_ranges", with_(IDX) + """, nxt as (
  select *, lead(start_byte) over (partition by file_id order by line_no) - 1 as end_byte from idx),
hit as (
  select *, case line_no % 3 when 0 then 'aod440' when 1 then 'aod550' else 'aod645' end as band
  from nxt where end_byte is not null and line_no <> 7 and not (name = 'N' and line_no > 5)),
best as (select *, row_number() over (partition by file_id, band order by line_no desc) as rn from hit)
select file_id, band as name, start_byte, end_byte from best
where rn = 1 and file_id in (select file_id from best where rn = 1 group by file_id having count(*) = 3)""")
def a2(spark, d):
    return message_index.aerosol_ranges(A.aerosol_lines(spark, d))


@query("a3_verify_assets", """with f as (
  select doc_id as name, source as url, sha256(text) as h from documents),
e as (
  select case when doc_id % 103 = 0 then -doc_id else doc_id end as name, source as url,
    sha256(case when doc_id % 97 = 0 then text || 'x' else text end) as h
  from documents where doc_id % 101 <> 0)
select coalesce(f.name, e.name) as name,
  case when f.h is null then 'missing' when e.h is null then 'unexpected'
       when f.url = e.url and f.h = e.h then 'ok' else 'changed' end as verdict
from f full outer join e on f.name = e.name""")
def a3(spark, d):
    return products.verify_assets(A.assets(spark, d), A.expected_assets(spark, d))


@query("a4_point_product", """with e as (
  select vec_id, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings),
p as (
  select vec_id, i, case when vec_id % 10 = 0 and i = 5 then 0 else i * 5 end as lon,
    case when vec_id % 10 = 0 and i = 5 then -40 else i - 40 end as lat,
    case when vec_id % 11 = 0 and i = 9 then 101 else floor(abs(v) * 100) end as value
  from e where not (vec_id % 13 = 0 and i = 63))
select vec_id, case when vec_id % 3 = 0 then null else 1790812800000000 + (vec_id % 7) * 86400000000 end as forecast_us,
  cast(lon as double) as lon, cast(lat as double) as lat, cast(value as double) as value from p
where vec_id % 10 <> 0 and vec_id % 11 <> 0 and vec_id % 13 <> 0""")
def a4(spark, d):
    i = "transform(embedding, (v, i) -> array("
    coords = f"""filter({i} cast(case when vec_id % 10 = 0 and i = 5 then 0 else i * 5 end as double),
        cast(case when vec_id % 10 = 0 and i = 5 then -40 else i - 40 end as double),
        cast(case when vec_id % 11 = 0 and i = 9 then 101 else floor(abs(cast(v as double)) * 100) end as double))),
        (p, i) -> not (vec_id % 13 = 0 and i = 63))"""
    docs = A.table(spark, d, "embeddings").selectExpr(
        "vec_id", f"to_json(named_struct('coordinates', {coords}, 'forecast', case when vec_id % 3 = 0 then 'soon' else concat('2026-10-0', 1 + vec_id % 7, 'T00:00:00Z') end)) as doc")
    return products.explode_points(products.scan_point_product(docs, "vec_id", "doc", min_points=64), "vec_id")


LINKS = """with p as (
  select page_id % 5 as product, cast(page_id % 24 as int) as hour, page_id, html,
    regexp_extract_all(html, 'href="/([a-z]+)"', 1) as k from pages),
l as (
  select product, hour, max(page_id) as page_id from p where len(k) > 0 and hour <= 20 and hour > 12 group by product, hour)"""


@query("a5_newest_listing", LINKS + """,
r as (select l.product, l.hour, k[len(k)] as key, row_number() over (partition by l.product order by l.hour desc) as rn
      from l join p on p.page_id = l.page_id)
select product, hour, key from r where rn = 1""")
def a5(spark, d):
    # Of several listings of an hour the latest page that lists anything counts.
    pages = A.table(spark, d, "pages").where(F.col("html").rlike('href="/[a-z]+"'))
    listings = pages.groupBy((F.col("page_id") % 5).alias("product"), (F.col("page_id") % 24).cast("int").alias("hour")) \
        .agg(F.max_by("html", "page_id").alias("text"))
    return products.latest_object(listings, 'href="/([a-z]+)"', F.lit(20), 8)


@query("a6_latest_daily", """with av as (
  select distinct event_id % 2 as hemisphere, cast(floor(epoch_us(ts) / 86400000000) as int) as day
  from events where event_type = 'signup'),
nows as (select distinct cast(floor(epoch_us(ts) / 86400000000) as int) as now_day from events),
n as (select now_day, hemisphere, max(day) as day from nows, av where day between now_day - 4 and now_day - 1 group by 1, 2)
select now_day, min(day) as product_day, max(day) as newest_day from n group by now_day having count(*) = 2""")
def a6(spark, d):
    days = A.events(spark, d).withColumn("day", F.floor(F.col("t_us") / 86_400_000_000).cast("int"))
    av = days.where("event_type = 'signup'").select((F.col("event_id") % 2).alias("hemisphere"), "day")
    return products.latest_daily(av, days.select(F.col("day").alias("now_day")).distinct())


ELEMENT_SETS = """with t as (
  select conv_id, turn,
    rpad('1 ' || lpad(cast(conv_id % 100000 as varchar), 5, '0') || 'U ', 69, '0') as l1,
    rpad('2 ' || lpad(cast(conv_id % 100000 as varchar), 5, '0') || '  ', 69, '3') as l2
  from conversations)
select a.conv_id as file_id, a.turn as line_no, a.conv_id % 100000 as object_id,
  'object ' || a.conv_id as name, a.l1, a.l2
from t a join t b on b.conv_id = a.conv_id and b.turn = a.turn + 1
where a.turn % 4 = 1 and a.conv_id % 7 <> 0 and a.conv_id % 11 <> 0"""


@query("a7_element_sets", ELEMENT_SETS)
def a7(spark, d):
    return catalogues.scan_elements(A.element_text(spark, d))


@query("a8_star_lines", with_(STARS) + """select star_id, ra, dec_deg, vmag, bv,
  cast(pm_ra as double) as pm_ra, cast(pm_dec as double) as pm_dec from stars
where star_id % 29 <> 0 and star_id % 31 <> 0 and star_id % 13 <> 0 and star_id % 17 <> 0""")
def a8(spark, d):
    return catalogues.parse_stars(A.star_lines(spark, d), keep=["star_id"])


@query("a9_raster_tiles", """with e as (
  select vec_id, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings),
b as (select vec_id, cast(floor(i / 8) as int) as y, cast(i % 8 as int) as x,
        cast(least(255e0, greatest(0e0, round_even((v + 1e0) * 127.5e0, 0))) as int) as r from e where vec_id % 19 <> 0)
select vec_id as key, cast(y + floor((vec_id % 8) / 4) * 8 as int) as y, cast(x + (vec_id % 4) * 8 as int) as x,
  r, 255 - r as g, cast(floor(r / 2) as int) as b from b""")
def a9(spark, d):
    tiles = A.table(spark, d, "embeddings").selectExpr(
        "vec_id as key", "concat('world.200409.', substring('ABCD', cast(vec_id % 4 + 1 as int), 1), cast(floor((vec_id % 8) / 4) + 1 as int), '.raw') as path",
        """unhex(concat(array_join(transform(transform(embedding,
             v -> cast(least(255e0, greatest(0e0, rint((cast(v as double) + 1e0) * 127.5e0))) as int)),
             r -> concat(lpad(hex(r), 2, '0'), lpad(hex(255 - r), 2, '0'), lpad(hex(cast(floor(r / 2) as int)), 2, '0'), 'FF')), ''),
             case when vec_id % 19 = 0 then '00' else '' end)) as payload""")
    named = tiles.withColumn("name", rasters.tile_name("path"))
    cells = rasters.decode_tiles(named, 8, 8, 4)
    return P.place_tiles(cells, rasters.tile_places(spark), 8, 8)


@query("a10_accept_grid", """with e as (
  select vec_id, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings),
c as (select vec_id, i, case when vec_id % 41 = 0 and i = 3 then null else v end as v from e where not (vec_id % 43 = 0 and i = 63))
select vec_id, count(*) as n, case when count(*) < 64 then 'wrong geometry' when vec_id % 47 = 0 then 'wrong time'
  when count(v) < count(*) then 'not finite' when max(abs(v)) > 0.35e0 then 'out of range' else 'ok' end as verdict
from c group by vec_id""")
def a10(spark, d):
    cells = A.table(spark, d, "embeddings").selectExpr("vec_id", "posexplode(embedding) as (i, v)").selectExpr(
        "vec_id", "cast(floor(i / 8) as int) as y", "i % 8 as x",
        "case when vec_id % 41 = 0 and i = 3 then null else cast(v as double) end as v", "i").where("not (vec_id % 43 = 0 and i = 63)")
    return products.accept_grid(cells, ["vec_id"], "v", 8, 8, 0.35, F.col("vec_id") % 47 != 0)


@query("a11_status_lines", """select event_id, cast(round(value * 1000) as bigint) as wait_us, event_type as scene,
  (event_id % 9) + 0.5e0 as gpu_total, cast(event_id % 3 as double) as star, cast(event_id % 7 as double) as earth,
  cast(event_id % 2 as double) as post from events""")
def a11(spark, d):
    t = telemetry.scan_status(A.status_lines(spark, d))
    return t.select("event_id", F.col("tags")["wait_us"].cast("bigint").alias("wait_us"), F.col("tags")["scene"].alias("scene"),
                    "gpu_total", *[F.col("gpu_parts")[p].cast("double").alias(p) for p in ("star", "earth", "post")])


@query("a11_report_samples", """select vec_id, 'S' || (vec_id % 6) as scene, 'out' as output, cast(i as double) as t,
  v as wait_ms from (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings) e""")
def a11b(spark, d):
    docs = A.table(spark, d, "embeddings").selectExpr("vec_id", """to_json(named_struct('scene', concat('S', vec_id % 6),
        'output', 'out', 'samples', transform(embedding, (v, i) -> named_struct('t', cast(i as double), 'wait_ms', cast(v as double))))) as json""")
    return telemetry.scan_report(docs)


@query("a12_closed_manifests", """with m as (
  select event_id, case when event_id % 50 = 0 then '{"k": 1, "extra": 2, "also": 3}' else props end as j from events)
select event_id, cast(json_extract(j, '$.k') as bigint) as k,
  case when event_id % 50 = 0 then 'also,extra' else '' end as unknown, event_id % 50 <> 0 as accepted from m""")
def a12(spark, d):
    docs = A.table(spark, d, "events").selectExpr(
        "event_id", """case when event_id % 50 = 0 then '{"k": 1, "extra": 2, "also": 3}' else props end as j""")
    out = manifests.closed_json(docs, "j", "k bigint", ["k"])
    return out.select("event_id", F.col("doc.k").alias("k"), F.array_join("unknown_keys", ",").alias("unknown"), "accepted")


@query("a13_publish_generation", """select cast(event_id % 4 as int) as part, count(*) as n, sum(user_id) as users
from events group by 1""".replace("sum(user_id)", "cast(sum(user_id) as bigint)"))
def a13(spark, d):
    root = f"{checkpoint_root(spark)}/generations-{uuid.uuid4().hex}"
    rows = A.table(spark, d, "events").select((F.col("event_id") % 4).cast("int").alias("part"), "user_id")
    generations.publish(rows, root, "first")
    generations.publish(rows, root, "second")
    return generations.read_generation(spark, root).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query("a14_packed_rows", with_(BYTES) + """select grid_id, y, count(*) as w,
  sha256(unhex(string_agg(printf('%02X%02X%02X%02X', b, g, r, a), '' order by x))) as sha256
from bytes group by grid_id, y""")
def a14(spark, d):
    rows = packed.export_bgra(A.byte_cells(spark, d), ["r", "g", "b", "a"])
    return rows.select("grid_id", "y", F.col("w").cast("bigint").alias("w"), "sha256")


def grid_layers(spark, d):
    """A pyramid layer per raster: 200 x 160 in tiles of 8, BC4 texels; one row per grid."""
    grids = A.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 500).cast("int").alias("layer")).distinct()
    return grids.withColumns({"base_w": F.lit(A.W), "base_h": F.lit(A.H), "mip_count": F.lit(9), "format": F.lit("BC4")})


PYRAMID_KEYS = """ly as (select distinct cast(floor(vec_id / 500) as int) as layer from embeddings),
lv as (select layer, unnest(range(9)) as mip from ly),
sz as (select layer, mip, greatest(1, cast(ceil(200 / pow(2e0, mip)) as int)) as w, greatest(1, cast(ceil(160 / pow(2e0, mip)) as int)) as h from lv),
yy as (select layer, mip, w, h, unnest(range(cast(ceil(h / 8e0) as int))) as y from sz),
keys as (select layer, cast(mip as int) as mip, w, cast(y as int) as y, cast(unnest(range(cast(ceil(w / 8e0) as int))) as int) as x from yy)"""


@query("a15_pyramid_index", "with " + PYRAMID_KEYS + """
select layer, mip, y, x, 0 as flags, 34848 as payload_bytes,
  cast(34848 * (row_number() over (order by layer, mip, y, x) - 1) as bigint) as payload_offset from keys""".replace("34848 as p", "cast(34848 as bigint) as p"))
def a15(spark, d):
    layers = P.layer_bases(grid_layers(spark, d), tile=8)
    tiles = P.expected_tiles(layers, tile=8).select("layer", "mip", "y", "x")
    return P.index_tiles(tiles, layers, tile=8)


@query("a15_aligned_offsets", """select doc_id, cast(coalesce(sum(cast(ceil(strlen(text) / 16e0) as bigint) * 16)
  over (order by source, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as payload_offset,
  row_number() over (order by source, doc_id) as ordinal from documents""")
def a15b(spark, d):
    files = A.table(spark, d, "documents").select("doc_id", "source", F.octet_length("text").alias("size"))
    out = P.aligned_offsets(files, ["source", "doc_id"], "size")
    return out.select("doc_id", "payload_offset", F.col("ordinal").cast("bigint").alias("ordinal"))


@query("a16_pyramid_tail", "with " + PYRAMID_KEYS + """,
o as (select *, cast(34848 * (row_number() over (order by layer, mip, y, x) - 1) as bigint) as payload_offset from keys)
select layer, mip, y, x, payload_offset - min(payload_offset) over (partition by layer) as tail_offset
from o where w <= 50""")
def a16(spark, d):
    layers = P.layer_bases(grid_layers(spark, d), tile=8)
    index = P.index_tiles(P.expected_tiles(layers, tile=8).select("layer", "mip", "y", "x"), layers, tile=8)
    return P.pyramid_tail(index, layers, 50).select("layer", "mip", "y", "x", "tail_offset")


@query("a17_provenance", """with recursive leaf as (select source, count(*) over (partition by source) as n, row_number() over (partition by source order by doc_id) - 1 as pos,
  sha256(doc_id || chr(10) || sha256(text) || chr(10) || strlen(text)) as hash from documents),
t as (select source, 0 as level, n, pos, hash from leaf union all
  select source, level + 1, (n + 15) // 16, pos // 16, sha256(string_agg(hash, '' order by pos)) from t where n > 1 group by source, level, n, pos // 16),
roots as (select source, arg_max(hash, level) as digest from t where n = 1 group by 1)
select source, count(*) as files, cast(sum(strlen(text)) as bigint) as bytes, 'https://data.example/' || source as credit, any_value(digest) as digest
from documents join roots using (source) group by source""")
def a17(spark, d):
    files = A.assets(spark, d).withColumn("source", F.regexp_replace("url", "^https://data.example/", ""))
    return provenance.provenance(files, ["source"], credit="url")


@query("a18_current_generation_files", with_(GEN) + """select product, gen_us, file_id, name from gen
qualify gen_us = max(gen_us) over (partition by product)""")
def a18(spark, d):
    """Two publications, the older files and then the newest of each product, and what a reader gets."""
    root = f"{checkpoint_root(spark)}/generations-{uuid.uuid4().hex}"
    files = A.generation_files(spark, d)
    newest = files.groupBy("product").agg(F.max("gen_us").alias("gen_us"))
    for gen, kind in (("older", "left_anti"), ("newest", "left_semi")):
        generations.publish(files.join(newest, ["product", "gen_us"], kind), root, gen)
    return generations.read_generation(spark, root).select("product", "gen_us", "file_id", "name")
