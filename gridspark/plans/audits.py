"""Bundle audits and benchmark reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pyramid import audit_layers, missing_channels
from ..operators.quantiles import exact_percentiles
from ..sources.products import verify_assets


def audit_bundles(layers: DataFrame, files: DataFrame, expected: DataFrame) -> DataFrame:
    """(bundle, missing channels, bad layers, bad files, ok). ``files``/``expected`` carry ``bundle`` per name."""
    missing = missing_channels(layers, ["bundle"]).groupBy("bundle").agg(F.count(F.lit(1)).alias("missing"))
    bad = audit_layers(layers, ["bundle"]).groupBy("bundle").agg(F.count_if(F.col("rule") != "ok").alias("bad_layers"))
    owner = files.select("name", "bundle").unionByName(expected.select("name", "bundle")).distinct()
    verdicts = verify_assets(files.drop("bundle"), expected.drop("bundle")).join(owner, "name")
    broken = verdicts.groupBy("bundle").agg(F.count_if(F.col("verdict") != "ok").alias("bad_files"))
    out = bad.join(missing, "bundle", "left").join(broken, "bundle", "left").na.fill(0)
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("bad_layers") == 0) & (F.col("bad_files") == 0))


def comparison_report(samples: DataFrame, value: str) -> DataFrame:
    """Per scene the medians of both runs, their reduction in percent and the sample counts.

    A scene without one of the runs is kept, with that side missing.
    """
    medians = exact_percentiles(samples, ["scene", "run"], value, {"median": 0.5})
    counts = samples.groupBy("scene", "run").agg(F.count(F.lit(1)).alias("n"))
    both = medians.join(counts, ["scene", "run"])
    wide = both.groupBy("scene").agg(*[
        F.max(F.when(F.col("run") == r, F.col(c))).alias(f"{r}_{n}")
        for r in ("before", "after") for c, n in (("median", "median"), ("n", "samples"))])
    reduction = F.when(F.col("before_median") != 0, (1.0 - F.col("after_median") / F.col("before_median")) * 100.0)
    return wide.withColumn("reduction", reduction)
