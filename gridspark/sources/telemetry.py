"""Renderer status lines and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_values

REPORT_SCHEMA = "struct<scene:string, output:string, samples:array<struct<t:double, wait_ms:double>>>"


def scan_status(lines: DataFrame, text: str = "status") -> DataFrame:
    """Tags of ``key=value`` text and the nested ``gpu_ms=total(part=..,..)`` timings."""
    nested = F.regexp_extract(text, r"gpu_ms=([\d.]+)\(([^)]*)\)", 2)
    total = F.regexp_extract(text, r"gpu_ms=([\d.]+)", 1).try_cast("double")
    parts = F.str_to_map(nested, F.lit(","), F.lit("="))
    return lines.withColumns({
        "tags": key_values(F.regexp_replace(text, r"\([^)]*\)", "")),
        "gpu_total": total, "gpu_parts": parts})


def scan_report(docs: DataFrame, text: str = "json") -> DataFrame:
    """One row per sample of a JSON report."""
    d = docs.withColumn("_d", F.from_json(text, REPORT_SCHEMA))
    return d.select(*[c for c in docs.columns if c != text], "_d.scene", "_d.output", F.inline("_d.samples"))
