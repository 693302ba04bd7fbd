"""Assets, listings, daily files, point products and decoded grids, with their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import iso_z


def scan_assets(spark: SparkSession, path: str) -> DataFrame:
    """Landed files as (name, sha256, bytes)."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"))


def verify_assets(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, verdict): ``ok`` when URL and hash agree, else ``changed``, ``missing``, ``unexpected``."""
    want = expected.select("name", F.col("url").alias("_url"), F.col("sha256").alias("_sha"))
    both = files.join(want, "name", "full_outer")
    verdict = (F.when(F.col("sha256").isNull(), "missing").when(F.col("_sha").isNull(), "unexpected")
               .when((F.col("url") == F.col("_url")) & (F.col("sha256") == F.col("_sha")), "ok").otherwise("changed"))
    return both.select("name", verdict.alias("verdict"))


POINT_SCHEMA = "struct<coordinates:array<array<double>>, forecast:string>"


def scan_point_product(docs: DataFrame, key: str, text: str, min_points: int = 64_000,
                       bounds: tuple[tuple[float, float], ...] = ((0, 359), (-90, 90), (0, 100))) -> DataFrame:
    """Per document: its points and the first broken rule, or ``ok``.

    A point is [lon, lat, value]. A document is one text value, so all rules are expressions on its
    array and no rows move.
    """
    parsed = docs.select(key, F.from_json(text, POINT_SCHEMA).alias("d")).select(key, "d.coordinates", "d.forecast")
    pts = F.col("coordinates")

    def outside(p):
        bad = F.lit(False)
        for i, (lo, hi) in enumerate(bounds):
            bad = bad | ~p[i].between(float(lo), float(hi))
        return bad

    node = F.transform(pts, lambda p: p[0] * 1000.0 + p[1])
    broken = F.exists(pts, lambda p: p[0].isNull() | p[1].isNull() | p[2].isNull()
                      | F.isnan(p[0]) | F.isnan(p[1]) | F.isnan(p[2]))
    rule = (F.when(pts.isNull(), "not a point list")
            .when(F.exists(pts, lambda p: F.size(p) != 3), "not triples")
            .when(F.size(pts) < min_points, "too few points")
            .when(broken, "not finite")
            .when(F.exists(pts, outside), "out of range")
            .when(F.exists(pts, lambda p: (p[0] != F.floor(p[0])) | (p[1] != F.floor(p[1]))), "not whole degrees")
            .when(F.size(F.array_distinct(node)) != F.size(pts), "repeated node").otherwise("ok"))
    # A forecast time that does not parse is NULL; it breaks no rule, for the points stand without it.
    return parsed.withColumns({"rule": rule, "forecast_us": iso_z("forecast")})


def explode_points(products: DataFrame, key: str) -> DataFrame:
    """(key, forecast_us, lon, lat, value) of the accepted documents."""
    return products.where(F.col("rule") == "ok").select(key, "forecast_us", F.explode("coordinates").alias("p")).select(
        key, "forecast_us", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"), F.col("p")[2].alias("value"))


def latest_object(listings: DataFrame, pattern: str, now_hour: Column, hours: int = 8) -> DataFrame:
    """Per product the newest hour of the last ``hours`` that lists a matching key, and its last key.

    A listing is (product, hour, text); keys stay in listed order, so the last match needs no explode.
    """
    keys = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    seen = listings.select("product", "hour", keys.alias("k")).where(
        (F.size("k") > 0) & (F.col("hour") <= now_hour) & (F.col("hour") > now_hour - hours))
    best = seen.groupBy("product").agg(F.max_by(F.element_at("k", -1), "hour").alias("key"), F.max("hour").alias("hour"))
    return best.select("product", "hour", "key")


def latest_daily(available: DataFrame, requests: DataFrame, back: int = 4, sides: int = 2) -> DataFrame:
    """Per request day the newest file of each hemisphere 1 to ``back`` days before, when all have one.

    ``available`` is (hemisphere, day), ``requests`` (now_day); days are numbers. The product day is the
    older of the hemispheres. Requests expand to their few candidate days, so the join is an equality.
    """
    want = requests.select("now_day", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(back)), lambda k: F.col("now_day") - k)).alias("day"))
    newest = want.join(available.distinct(), "day").groupBy("now_day", "hemisphere").agg(F.max("day").alias("day"))
    return newest.groupBy("now_day").agg(F.count(F.lit(1)).alias("_n"), F.min("day").alias("product_day"),
                                         F.max("day").alias("newest_day")).where(F.col("_n") == sides).drop("_n")


def accept_grid(cells: DataFrame, by: list[str], band: str, height: int, width: int, limit: float,
                valid: Column | None = None) -> DataFrame:
    """(by, n, verdict): a decoded message is accepted when complete, finite, in range and on time.

    One partially aggregated pass; the accepted cells follow with a semi join.
    """
    valid = F.lit(True) if valid is None else valid
    v = F.col(band)
    stats = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("_k"), F.max(F.abs(v)).alias("_m"),
        F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"),
        F.bool_and(valid).alias("_t"))
    shape = (F.col("_y0") == 0) & (F.col("_y1") == height - 1) & (F.col("_x0") == 0) & (F.col("_x1") == width - 1) \
        & (F.col("n") == height * width)
    verdict = (F.when(~shape, "wrong geometry").when(~F.col("_t"), "wrong time")
               .when((F.col("_k") < F.col("n")) | F.isnan("_m"), "not finite")
               .when(F.col("_m") > limit, "out of range").otherwise("ok"))
    return stats.select(*by, "n", verdict.alias("verdict"))
