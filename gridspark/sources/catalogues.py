"""Element sets and star catalogues as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import neighbour, running
from .lines import numbered_lines

CHUNK_LINES = 100_000


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (file_id, line_no, line)."""
    return numbered_lines(spark, path)


def scan_elements(lines: DataFrame, default_name: str = "UNKNOWN") -> DataFrame:
    """(file_id, line_no, object_id, name, l1, l2) of every two-line set.

    Blank lines do not count. A set is a 69-character line 1 and the next line, when that is a line 2
    of the same catalogue number. The name is the last other line before it.
    """
    text = F.trim("line")
    kept = lines.select("file_id", "line_no", text.alias("line")).where(F.col("line") != "")
    shape = F.regexp_extract("line", r"^([12]) +(\d{5})", 1)
    number = F.regexp_extract("line", r"^([12]) +(\d{5})", 2)
    kind = F.when((shape != "") & (F.length("line") == 69), shape).otherwise("n")
    kept = kept.withColumns({"_kind": kind, "_number": number})
    named = running(kept, ["file_id"], ["line_no"], CHUNK_LINES,
                    {"_name": ("last", F.when(F.col("_kind") == "n", F.col("line")))})
    paired = neighbour(named, ["file_id"], ["line_no"], CHUNK_LINES, {
        "_k2": F.col("_kind"), "_n2": F.col("_number"), "_l2": F.col("line")})
    sets = paired.where((F.col("_kind") == "1") & (F.col("_k2") == "2") & (F.col("_number") == F.col("_n2")))
    return sets.select("file_id", "line_no", F.col("_number").cast("bigint").alias("object_id"),
                       F.coalesce("_name", F.lit(default_name)).alias("name"),
                       F.col("line").alias("l1"), F.col("_l2").alias("l2"))


def parse_stars(lines: DataFrame, text: str = "line", keep: list[str] | None = None) -> DataFrame:
    """Rows of exactly six numbers; comments, blanks and broken rows are dropped."""
    fields = F.transform(F.split(F.col(text), ","), lambda s: F.trim(s).try_cast("double"))
    names = ["ra", "dec_deg", "vmag", "bv", "pm_ra", "pm_dec"]
    rows = lines.where((F.col(text) != "") & ~F.col(text).startswith("#")).withColumn("_f", fields)
    rows = rows.where((F.size("_f") == 6) & ~F.exists("_f", lambda v: v.isNull()))
    return rows.select(*(keep or []), *[F.col("_f")[i].alias(n) for i, n in enumerate(names)])
