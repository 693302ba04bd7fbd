"""The given tables seen as domain frames.

Each function takes the session and the folder of the tables and returns one domain frame over all of
its rows. Rasters have a fixed extent: more rows in the source table mean more grids, never a larger one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.timefn import micros

# Extent of one raster made from 500 vectors of 8x8 cells, and of the small observation grid.
H, W = 160, 200
OBS_H, OBS_W = 10, 15


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark, folder) -> DataFrame:
    return table(spark, folder, "events").withColumn("t_us", micros("ts"))


def event_stream(spark, folder) -> DataFrame:
    """The events as a stream, with their time as a TIMESTAMP for watermarks.

    The files of a table at rest are not in order of time, so a run takes all that are there as one batch.
    """
    schema = table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")
    return rows.withColumn("t_us", micros("ts")).withColumn("time", F.timestamp_micros("t_us"))


def observations(spark, folder) -> DataFrame:
    """Satellite-like counts on a 15 x 10 grid."""
    return as_observations(events(spark, folder))


def as_observations(rows: DataFrame, *more: str) -> DataFrame:
    return rows.selectExpr(
        *more, "event_id", "t_us", "case when event_id % 2 = 0 then 'VIS' else 'LW' end as product",
        "cast(floor((user_id % 150) / 15) as int) as y", "cast(user_id % 15 as int) as x",
        "90e0 - (floor((user_id % 150) / 15) + 0.5e0) * 18e0 as lat",
        "-180e0 + (user_id % 15 + 0.5e0) * 24e0 as lon", "value as cnt")


def requests(spark, folder) -> DataFrame:
    """Tile requests over a 4-level pyramid of 8x4, 4x2, 2x1 and 1x1 tiles."""
    return as_requests(events(spark, folder))


def as_requests(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "event_id", "t_us", "1 as layer", "cast(user_id % 4 as int) as mip",
        "cast(event_id % (case user_id % 4 when 0 then 8 when 1 then 4 when 2 then 2 else 1 end) as int) as x",
        "cast(floor(event_id / 8) as int) % (case user_id % 4 when 0 then 4 when 1 then 2 else 1 end) as y",
        "cast(floor(value) as int) as priority",
        "case when event_type in ('view', 'click') then 1 else 0 end as kind",
        "cast(floor(event_id / 10) as int) as frame")


def index_lines(spark, folder) -> DataFrame:
    """Message-index lines: (file_id, line_no, text) with colon-separated fields."""
    lines = table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("line_no")).agg(
        F.min("l_returnflag").alias("name"), (F.min(F.col("l_quantity").cast("bigint")) * 1000).alias("q"))
    # An order has at most seven distinct lines here, so this window is small by construction.
    lines = lines.selectExpr("*", """cast(coalesce(sum(q) over (partition by file_id order by line_no
        rows between unbounded preceding and 1 preceding), 0) as bigint) as start_byte""")
    return lines.select("file_id", "line_no", F.concat_ws(
        ":", "line_no", "start_byte", F.lit("d=2024010100"), "name", F.lit("surface"), F.lit("anl"), F.lit("")).alias("text"))


def aerosol_lines(spark, folder) -> DataFrame:
    """Index lines with an aerosol type in field 6 and a wavelength in field 8."""
    return index_lines(spark, folder).select(
        "file_id", "line_no", F.split("text", ":").alias("f")).selectExpr(
        "file_id", "line_no", """concat_ws(':', f[0], f[1], f[2], case when line_no = 7 then 'PMTF' else 'AOTK' end,
            'entire atmosphere', 'anl', case when f[3] = 'N' and line_no > 5 then 'aerosol=Dust' else 'aerosol=Total aerosol' end,
            'aerosol_size <2e-05',
            case line_no % 3 when 0 then 'aerosol_wavelength >=4.3e-07,<=4.5e-07'
                             when 1 then 'aerosol_wavelength >=5.45e-07,<=5.65e-07'
                             else 'aerosol_wavelength >=6.2e-07,<=6.7e-07' end) as text""")


def telemetry(spark, folder) -> DataFrame:
    return events(spark, folder).selectExpr(
        "event_id", "t_us", "case when event_id % 2 = 0 then 'before' else 'after' end as run",
        "event_type as scene", "value as wait_ms")


def status_lines(spark, folder) -> DataFrame:
    """Renderer status text with nested timings; whole microseconds keep the text exact."""
    return events(spark, folder).selectExpr(
        "event_id", """concat('fps=', user_id, ' wait_us=', cast(round(value * 1000) as bigint), ' scene=', event_type,
            ' gpu_ms=', event_id % 9, '.5(star=', event_id % 3, ',earth=', event_id % 7, ',post=', event_id % 2, ')') as status""")


def elements(spark, folder) -> DataFrame:
    return events(spark, folder).where("event_type = 'click'").selectExpr(
        "user_id as object_id", "t_us as epoch_us", "event_id as element_id")


def instants(spark, folder) -> DataFrame:
    return events(spark, folder).where("event_type = 'error'").selectExpr(
        "user_id as object_id", "t_us", "event_id as instant_id")


def element_text(spark, folder) -> DataFrame:
    """Conversation turns as element-set text: name, line 1, line 2, blank; some files are broken."""
    return table(spark, folder, "conversations").selectExpr(
        "conv_id as file_id", "turn as line_no", """case turn % 4
            when 0 then concat(' object ', conv_id, ' ')
            when 1 then rpad(concat('1 ', lpad(cast(conv_id % 100000 as string), 5, '0'), 'U '),
                             case when conv_id % 7 = 0 then 68 else 69 end, '0')
            when 2 then rpad(concat('2 ', lpad(cast((case when conv_id % 11 = 0 then conv_id + 1 else conv_id end) % 100000
                             as string), 5, '0'), '  '), 69, '3')
            else '   ' end as line""")


def stars(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey as star_id", "(c_custkey * 137.508e0) % 360e0 as ra",
        "(c_custkey * 0.61803e0) % 180e0 - 90e0 as dec_deg",
        "-2e0 + (c_acctbal + 1000e0) / 11000e0 * 10e0 as vmag", "c_nationkey / 24e0 * 3e0 - 0.5e0 as bv",
        "cast(c_custkey % 2001 as int) - 1000 as pm_ra", "cast(c_custkey % 1501 as int) - 750 as pm_dec")


def star_lines(spark, folder) -> DataFrame:
    """The catalogue as comma-separated text, with comments, blanks and broken rows among it."""
    return stars(spark, folder).selectExpr("star_id", """case
        when star_id % 29 = 0 then '# note' when star_id % 31 = 0 then ''
        when star_id % 13 = 0 then concat_ws(',', ra, 'x', vmag, bv, pm_ra, pm_dec)
        when star_id % 17 = 0 then concat_ws(',', ra, dec_deg, vmag, bv, pm_ra)
        else concat_ws(', ', ra, dec_deg, vmag, bv, pm_ra, pm_dec) end as line""")


def generation_files(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("product"), micros("o_orderdate").alias("gen_us"),
        F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("name"))


def assets(spark, folder) -> DataFrame:
    """Landed files as (name, url, sha256, bytes)."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("name"), F.concat(F.lit("https://data.example/"), F.col("source")).alias("url"),
        F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


def expected_assets(spark, folder) -> DataFrame:
    text = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return (table(spark, folder, "documents").where("doc_id % 101 <> 0").select(
        (F.when(F.col("doc_id") % 103 == 0, -F.col("doc_id")).otherwise(F.col("doc_id"))).alias("name"),
        F.concat(F.lit("https://data.example/"), F.col("source")).alias("url"),
        F.sha2(text, 256).alias("sha256")))


def cells(spark, folder) -> DataFrame:
    """The raster: each vector is an 8x8 tile, 25 tiles across and 20 down a grid."""
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id", "posexplode(embedding) as (i, v)").selectExpr(
        "cast(floor(vec_id / 500) as int) as grid_id",
        "cast(floor((vec_id % 500) / 25) * 8 + floor(i / 8) as int) as y",
        "cast((vec_id % 25) * 8 + i % 8 as int) as x", "cast(v as double) as v")


def byte_cells(spark, folder) -> DataFrame:
    """Four byte bands on the raster."""
    return cells(spark, folder).selectExpr(
        "grid_id", "y", "x", "cast(least(255e0, greatest(0e0, rint((v + 1e0) * 127.5e0))) as int) as r").selectExpr(
        "grid_id", "y", "x", "r", "(r * 3 + x) % 256 as g", "(r * 5 + y) % 256 as b", "(r * 7 + x + y) % 256 as a")


def sky_cells(spark, folder) -> DataFrame:
    """Satellite fields on the raster with gaps: visible, infrared, its composites, model bands."""
    return cells(spark, folder).selectExpr(
        "grid_id", "y", "x",
        "case when (x * 7 + y * 13) % 29 = 0 then null else least(1.2e0, greatest(0e0, 0.3e0 + v)) end as albedo",
        "case when (x + y * 3) % 37 = 0 then null else 0.1e0 + (y % 9) * 0.05e0 end as vis_clear",
        "case when (x * 5 + y * 3) % 31 = 0 then null else rint(least(254e0, greatest(1e0, 120e0 + v * 250e0))) end as ir",
        "case when (x + y) % 23 = 0 then null else 60e0 + (x % 17) end as ir_night",
        "case when (x + y) % 19 = 0 then null else 75e0 + (y % 13) end as ir_day",
        "0.5e0 + v as model", "0.4e0 - v as low",
        "(x % 100) / 100e0 as cosine")
