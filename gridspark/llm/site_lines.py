"""Line dedup by site-relative frequency.

For every host, the share of its pages that hold a line decides: a line on more than ``ratio`` of the pages of its
host, and on ``least_pages`` of them at least, is boilerplate there and is dropped from each page of the host.

Lines are counted as 128-bit hashes, once per page, with partial sums before the shuffle, so a host with a third of
all pages is summed where it is read. The boilerplate of a host is a short list: a host whose pages have L distinct
lines on average has fewer than L / ratio of them. Page totals and that list, each one row per host, are written to the
shared folder before they are joined, so Spark knows their size: below the broadcast threshold the texts are filtered where they
are read, and beyond it the join is an ordinary one whose hot hosts adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import shared_table

RATIO = 0.1
LEAST_PAGES = 3


def _lines(text: Column, pattern: str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), pattern)


def _mark(line: Column) -> Column:
    trimmed = F.trim(line)
    return F.concat_ws(":", F.xxhash64(trimmed), F.xxhash64(F.reverse(trimmed), F.lit(1)))


def drop_boilerplate(df: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES,
                     pattern: str = "\n", result: str | None = None, dropped: str | None = None) -> DataFrame:
    """Return ``df`` with boilerplate lines taken out of ``text``.

    ``pattern`` splits a text into lines; the kept ones are joined by newlines, in order. Lines are compared without
    blanks around them, and blank lines are never dropped. A NULL host is a host of its own. A NULL text stays NULL
    and counts as a page without lines. Each row is a page, repeated rows included. ``result`` names the output
    column (default: ``text`` is replaced), ``dropped`` a column for the number of dropped lines; columns that
    already have these names are replaced, all others are carried.
    """
    out = result or text
    fresh = {out.lower(), (dropped or out).lower()}
    carried = [c for c in df.columns if c.lower() not in fresh]
    place, body = F.coalesce(F.concat(F.lit("h"), F.col(f"`{host}`").cast("string")), F.lit("")), F.col(f"`{text}`")
    lines = _lines(body, pattern)
    marks = F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), _mark))
    total = shared_table(df.select(place.alias("__host")).groupBy("__host").agg(F.count("*").alias("__pages")))
    counts = (df.select(place.alias("__host"), F.explode(marks).alias("__mark")).groupBy("__host", "__mark")
              .agg(F.count("*").alias("__n")).where(F.col("__n") >= least_pages))
    common = shared_table(counts.join(total, "__host").where(F.col("__n") > F.col("__pages") * F.lit(float(ratio)))
                          .groupBy("__host").agg(F.collect_list("__mark").alias("__common")))
    joined = df.select(*[F.col(f"`{c}`") for c in carried], place.alias("__host"), body.alias("__text")).join(
        common, "__host", "left")
    known = F.coalesce("__common", F.array().cast("array<string>"))
    parts = _lines(F.col("__text"), pattern)
    kept = F.when(F.size(known) == 0, parts).otherwise(
        F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains(known, _mark(x))))
    text_out = F.when(F.col("__text").isNotNull(), F.array_join("__kept", "\n"))
    return joined.withColumn("__kept", kept).select(
        *[F.col(f"`{c}`") for c in carried], text_out.alias(out),
        *([(F.size(parts) - F.size("__kept")).cast("bigint").alias(dropped)] if dropped else []))
