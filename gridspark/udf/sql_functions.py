"""The scalar family as SQL functions, table functions over lines of files, and two Arrow aggregates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

# Bodies are SQL, so the optimiser inlines them; none of these leaves the JVM.
SQL_FUNCTIONS = {
    "grid_clip(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE":
        "CASE WHEN x IS NOT NULL THEN greatest(lo, least(hi, x)) END",
    "grid_smoothstep(e0 DOUBLE, e1 DOUBLE, x DOUBLE) RETURNS DOUBLE":
        "pow(grid_clip((x - e0) / (e1 - e0), 0D, 1D), 2D) * (3D - 2D * grid_clip((x - e0) / (e1 - e0), 0D, 1D))",
    "grid_row_lat(y INT, height INT) RETURNS DOUBLE": "90D - (y + 0.5D) * (180D / height)",
    "grid_col_lon(x INT, width INT) RETURNS DOUBLE": "-180D + (x + 0.5D) * (360D / width)",
    "grid_srgb_to_linear(b DOUBLE) RETURNS DOUBLE":
        "CASE WHEN b / 255D <= 0.04045D THEN b / 255D / 12.92D ELSE pow((b / 255D + 0.055D) / 1.055D, 2.4D) END",
    "tile_parent(x INT) RETURNS INT": "shiftright(x, 1)",
    "wrapped_distance(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "least(abs(a - b), 1D - abs(a - b))",
}


# Types are objects, not text, so that this module imports before a session exists.
RANGES = T.StructType([
    T.StructField("line_no", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType())])
SETS = T.StructType([
    T.StructField("line_no", T.LongType()), T.StructField("object_id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("l1", T.StringType()), T.StructField("l2", T.StringType())])


def _by_file(lines: AnalyzeArgument, fields: list[T.StructField]) -> AnalyzeResult:
    """Rows of a file come to one instance, in order of their lines; the result begins with the table's own file_id."""
    if not lines.isTable:
        raise ValueError("the argument is a table of lines")
    schema = T.StructType([T.StructField("file_id", lines.dataType["file_id"].dataType), *fields])
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn("file_id")], orderBy=[OrderingColumn("line_no")])


@udtf
class IndexRanges:
    """Byte ranges of index files: ``SELECT * FROM index_ranges(TABLE(lines))`` over (file_id, line_no, text).

    A row holds one line, or several in order, parted by line feeds: what a row costs on its way to Python is then paid
    once for all of them. A message ends before the next line, so the last line of a file has no range. Only one line and
    one row are held.
    """

    def __init__(self):
        self.held, self.number = None, 0

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        return _by_file(lines, RANGES.fields)

    def eval(self, line: Row):
        file = line["file_id"]
        for text in (line["text"] or "").split("\n"):
            if not text:
                continue
            fields = text.split(":")
            if self.held:
                yield file, self.number, self.held[3], int(self.held[1]), int(fields[1]) - 1
            self.held, self.number = fields, self.number + 1


@udtf
class ElementSets:
    """Two-line element sets: ``SELECT * FROM element_sets(TABLE(lines))`` over (file_id, line_no, line).

    Blank lines do not count. A first line of 69 characters and the second line right after it, of the same number, are a
    set; its name is the last other line before. Two lines and a name are held.
    """

    HEAD = re.compile(r"([12]) +(\d{5})", re.ASCII)

    def __init__(self):
        self.name, self.first = "UNKNOWN", None

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        return _by_file(lines, SETS.fields)

    def eval(self, line: Row):
        text = (line["line"] or "").strip(" ")
        if not text:
            return
        head = self.HEAD.match(text) if len(text) == 69 else None
        kind, number = head.groups() if head else ("n", None)
        if kind == "2" and self.first and self.first[1] == number:
            yield line["file_id"], self.first[0], int(number), self.first[3], self.first[2], text
        if kind == "n":
            self.name = text
        self.first = (line["line_no"], number, text, self.name) if kind == "1" else None


@pandas_udf(T.DoubleType())
def weighted_median(value: pd.Series, weight: pd.Series) -> float:
    """First value whose cumulative weight reaches half. For groups of bounded size, such as one grid row."""
    order = np.argsort(value.to_numpy(), kind="stable")
    total = np.cumsum(weight.to_numpy()[order])
    return float(value.to_numpy()[order][np.searchsorted(total, 0.5 * total[-1])])


PIECE_BYTES = 16 << 20


@pandas_udf(T.LongType())
def fnv1a32_large(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """32-bit FNV-1a of binary payloads of any length; NULL for NULL.

    The hash takes one byte after another, so payloads take their k-th byte together, the longest first. Payloads of a batch
    go in pieces of about PIECE_BYTES, so what is copied does not grow with the batch; only a single longer one goes beyond.
    """
    for batch in payloads:
        known = batch[batch.notna()]
        out = np.zeros(len(known), np.int64)
        size = known.map(len).to_numpy(np.int64)
        order = np.argsort(-size, kind="stable")
        piece = (np.cumsum(size[order]) - 1) // PIECE_BYTES
        for part in np.split(order, np.flatnonzero(np.diff(piece)) + 1):
            out[part] = _fnv1a32([known.iloc[k] for k in part])
        hashes = pd.Series(pd.NA, index=batch.index, dtype="Int64")
        hashes.loc[known.index] = out
        yield hashes


def _fnv1a32(payloads: list[bytes]) -> np.ndarray:
    """The hashes of payloads in order of falling length."""
    size = np.fromiter(map(len, payloads), np.int64, len(payloads))
    data = np.frombuffer(b"".join(payloads), np.uint8)
    start, state = np.cumsum(size) - size, np.full(len(size), 2166136261, np.uint64)
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # payloads with a k-th byte
    for k, many in enumerate(live.tolist()):
        state[:many] = ((state[:many] ^ data[start[:many] + k]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    return state.astype(np.int64)


def register(spark: SparkSession) -> None:
    """Make everything callable from SQL in this session."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("index_ranges", IndexRanges)
    spark.udtf.register("element_sets", ElementSets)
    spark.udf.register("weighted_median", weighted_median)
    spark.udf.register("fnv1a32_large", fnv1a32_large)
