"""Star and orbit compositions, block codes, SQL functions."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import numeric as N, stars as S, timefn
from ..functions.colour import linear_to_srgb
from ..functions.text import element_checksum, element_line_ok
from ..operators import pyramid as P
from ..operators.quantiles import exact_percentiles
from ..plans import quality
from ..sources import message_index
from ..udf import sql_functions
from .registry import query
from .scalars import CODES
from .scans import ELEMENT_SETS
from .views import BYTES, CELLS, SKY, STARS, r6, srgb, step, with_


@query("k13_star_background", with_(BYTES) + f""", q as (select grid_id, y, x, pow(r / 255e0, 3e0) as r, pow(g / 255e0, 3e0) as g, pow(b / 255e0, 3e0) as b from bytes),
w as (select grid_id, quantile_cont(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b, 0.99998) as white from q where y % 4 = 0 and x % 4 = 0 group by 1)
select grid_id, y, x, {", ".join(f"round_even(round({srgb(c + ' / greatest(white, 1e-12)')} * 255e0, 6), 0)::int as {c}" for c in "rgb")} from q join w using (grid_id)""")
def k13(spark, d):
    radiance = A.byte_cells(spark, d).select("grid_id", "y", "x", *[F.pow(F.col(c) / 255.0, F.lit(3.0)).alias(c) for c in "rgb"])
    sub = radiance.where("y % 4 = 0 and x % 4 = 0")
    luma = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    white = exact_percentiles(sub, ["grid_id"], luma, {"white": 0.99998})
    out = radiance.join(white, "grid_id")
    return out.select("grid_id", "y", "x", *[
        F.rint(F.round(linear_to_srgb(F.col(c) / F.greatest(F.col("white"), F.lit(1e-12))) * 255.0, 6)).cast("int").alias(c) for c in "rgb"])


@query("k13_packed_catalogue", with_(STARS, CODES) + """, o as (select star_id, row_number() over (order by vmag desc, star_id) - 1 as i from stars)
select star_id, floor(i / 256)::int as row, (i % 256)::int as col, ra_code::bigint * 256 + (dec_code >> 16) as word0,
  (dec_code & 65535)::bigint * 65536 + mag_code * 256 + bv_code as word1, pm_ra_code::bigint * 65536 + pm_dec_code as word2 from o join codes using (star_id)""")
def k13b(spark, d):
    from ..operators.ordered import global_order
    ranked = global_order(A.stars(spark, d), [F.desc("vmag"), F.asc("star_id")], rank="i")
    coded = ranked.select("star_id", (F.col("i") - 1).alias("i"), *[c.alias(n) for n, c in S.encode().items()])
    return coded.select("star_id", F.floor(F.col("i") / 256).cast("int").alias("row"), (F.col("i") % 256).cast("int").alias("col"),
                        *[c.alias(n) for n, c in S.pack_words().items()])


@query("j1_sql_functions", with_(SKY) + f"""select grid_id, y, x, {r6(step('0.02e0', '0.45e0', 'albedo'))} as cloud,
  90e0 - (y + 0.5e0) * 1.125e0 as lat, y >> 1 as parent from sky""")
def j1(spark, d):
    sql_functions.register(spark)
    return spark.sql(f"""select grid_id, y, x, round(grid_smoothstep(0.02D, 0.45D, albedo), 6) + 0D as cloud,
        grid_row_lat(y, {A.H}) as lat, tile_parent(y) as parent from {{sky}}""", sky=A.sky_cells(spark, d))


@query("j2_payload_hashes", """select doc_id, list_reduce(list_prepend(2166136261::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::bigint)),
  lambda h, b: (xor(h, b) * 16777619) % 4294967296) as fnv from documents""")
def j2(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("p"))
    return docs.select("doc_id", sql_functions.fnv1a32_large("p").alias("fnv"))


@query("j3_index_table_function", """with idx as (
  select l_orderkey as file_id, l_linenumber as line_no, min(l_returnflag) as name, min(cast(l_quantity as bigint)) * 1000 as q from lineitem group by 1, 2),
s as (select file_id, line_no, name, coalesce(sum(q) over (partition by file_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as start_byte,
  row_number() over (partition by file_id order by line_no)::int as n from idx)
select file_id, n as line_no, name, start_byte, lead(start_byte) over (partition by file_id order by line_no) - 1 as end_byte from s
qualify lead(start_byte) over (partition by file_id order by line_no) is not null""")
def j3(spark, d):
    sql_functions.register(spark)
    return spark.sql("select * from index_ranges(table(select * from {lines}))", lines=message_index.packed_lines(A.index_lines(spark, d)))


@query("j3_element_table_function", ELEMENT_SETS)
def j3b(spark, d):
    sql_functions.register(spark)
    return spark.sql("select * from element_sets(table(select * from {lines}))", lines=A.element_text(spark, d))


@query("j4_weighted_median_per_row", with_(CELLS) + """, c as (select grid_id, y, v, sum(1 + x % 5) over (partition by grid_id, y order by v) as cum, sum(1 + x % 5) over (partition by grid_id, y) as total from cells)
select grid_id, y, round(min(v), 6) + 0e0 as median from c where cum >= 0.5e0 * total group by 1, 2""")
def j4(spark, d):
    cells = A.cells(spark, d).withColumn("w", (1 + F.col("x") % 5).cast("double"))
    return cells.groupBy("grid_id", "y").agg(N.r6(sql_functions.weighted_median("v", "w")).alias("median"))
