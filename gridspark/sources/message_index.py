"""Model message indexes: colon-separated lines giving the byte start of each message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import neighbour
from ..session import literal_table
from .lines import numbered_lines

# Lines per chunk of an ordered scan; an index file is far shorter.
CHUNK_LINES = 100_000
# Line numbers that go to a table function in one row.
PACKED_LINES = 1000
# The wanted aerosol wavelengths by band.
WAVELENGTHS = (("4.3e-07", "aod440"), ("5.45e-07", "aod550"), ("6.2e-07", "aod645"))


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    """Index files as (file_id, line_no, text)."""
    return numbered_lines(spark, path).select("file_id", "line_no", F.col("line").alias("text")).where(F.col("text") != "")


def packed_lines(lines: DataFrame, most: int = PACKED_LINES) -> DataFrame:
    """Lines as rows of up to ``most`` line numbers each: their texts in order, parted by line feeds, at the first number."""
    parts = lines.groupBy("file_id", F.floor(F.col("line_no") / most).alias("_part")).agg(
        F.min("line_no").alias("line_no"), F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("_l"))
    return parts.select("file_id", "line_no", F.array_join("_l.text", "\n").alias("text"))


def _with_end(lines: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """The byte range of each line and ``fields`` of its parts ``f``; the last line of a file has no end and is dropped.

    Lines are sorted and joined on the way, so only what the caller asks for goes along, and no text or list of parts.
    """
    parts = lines.select("file_id", "line_no", F.split("text", ":").alias("f"))
    parsed = parts.select("file_id", "line_no", F.col("f")[1].cast("bigint").alias("start_byte"), *[c.alias(n) for n, c in fields.items()])
    ranged = neighbour(parsed, ["file_id"], ["line_no"], CHUNK_LINES, {"_next": F.col("start_byte")})
    return ranged.where(F.col("_next").isNotNull()).withColumn("end_byte", F.col("_next") - 1).drop("_next")


def _complete(found: DataFrame, names: list[str]) -> DataFrame:
    """The last range of each name, of files that hold every wanted name.

    A file is reduced to one range per wanted name (a handful), so no second pass over the lines is needed.
    """
    ranges = found.groupBy("file_id").agg(*[
        F.max(F.when(F.col("name") == n, F.struct("line_no", "start_byte", "end_byte"))).alias(f"_r{i}")
        for i, n in enumerate(names)])
    whole = ranges.dropna(subset=[f"_r{i}" for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_r{i}.start_byte").alias("start_byte"),
                              F.col(f"_r{i}.end_byte").alias("end_byte")) for i, n in enumerate(names)])
    return whole.select("file_id", F.inline(rows))


def message_ranges(lines: DataFrame, wanted: list[tuple[str, str, str]]) -> DataFrame:
    """Byte ranges of the wanted (variable, level, name) messages of each complete index.

    The range ends before the next line of any kind, so the successor is found before the filter.
    """
    table = literal_table(lines.sparkSession, wanted, "variable string, level string, name string")
    parsed = _with_end(lines, {"variable": F.col("f")[3], "level": F.col("f")[4]})
    found = parsed.join(table, ["variable", "level"])
    return _complete(found, sorted({name for _, _, name in wanted}))


def aerosol_ranges(lines: DataFrame) -> DataFrame:
    """Byte ranges of total-aerosol optical depth at the three wanted wavelengths."""
    table = literal_table(lines.sparkSession, list(WAVELENGTHS), "low string, name string")
    f = F.col("f")
    total = (F.size(f) > 8) & (F.get(f, F.lit(3)) == "AOTK") & (F.get(f, F.lit(6)) == "aerosol=Total aerosol")
    low = F.regexp_replace(F.split(F.get(f, F.lit(8)), ",")[0], "^aerosol_wavelength >=", "")
    parsed = _with_end(lines, {"low": F.when(total, low)})
    return _complete(parsed.join(table, "low"), [name for _, name in WAVELENGTHS])
