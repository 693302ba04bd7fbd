"""Tile request analytics: count, merge, order, age, prefetch and budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles as T
from .ordered import global_order, running

KEY = T.KEY


def count_requests(hits: DataFrame) -> DataFrame:
    """Ray hits per tile over all outputs."""
    return hits.groupBy(*KEY).agg(F.count(F.lit(1)).alias("priority"))


def merge_requests(requests: DataFrame) -> DataFrame:
    """One row per tile: the highest priority, the strongest kind, the newest frame."""
    return requests.groupBy(*KEY).agg(F.max("priority").alias("priority"), F.max("kind").alias("kind"),
                                      F.max("frame").alias("frame"))


def valid_requests(requests: DataFrame, layers: DataFrame, streamed_mips: int, tile: int = T.TILE) -> DataFrame:
    """Requests inside their level's grid and under the streamed level count."""
    keep = requests.join(layers.select("layer", "base_w", "base_h", "mip_count"), "layer")
    keep = keep.where(T.in_grid("base_w", "base_h", "mip_count", "mip", "x", "y", tile) & (F.col("mip") < streamed_mips))
    return keep.select(*requests.columns)


def fold_parents(requests: DataFrame, mips: int) -> DataFrame:
    """Each request also adds its priority to the next coarser tile; priorities add up per key."""
    own = F.struct("mip", "y", "x")
    parent = F.struct((F.col("mip") + 1).alias("mip"), F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x"))
    both = F.when(F.col("mip") + 1 < mips, F.array(own, parent)).otherwise(F.array(own))
    sent = requests.where(F.col("mip") < mips).select("layer", F.explode(both).alias("k"), "priority", "frame")
    return sent.groupBy("layer", F.col("k.mip").alias("mip"), F.col("k.y").alias("y"), F.col("k.x").alias("x")) \
        .agg(F.sum("priority").alias("priority"), F.max("frame").alias("frame"))


def mip_histogram(requests: DataFrame) -> DataFrame:
    """Requests and wanted tiles per (layer, mip) with sub-totals.

    Requests are counted per tile first, so the distinct count is a plain count.
    """
    per_tile = requests.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return per_tile.cube("layer", "mip").agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("tiles"),
                                             F.grouping_id().cast("int").alias("level"))


def top_requests(requests: DataFrame, k: int = 16_384) -> DataFrame:
    """The k requests of highest priority, ties by key; a per-partition top-k comes before the exchange."""
    return requests.orderBy(F.desc("priority"), *KEY).limit(k)


def service_order(requests: DataFrame) -> DataFrame:
    """Merged requests with their place in service: kind, priority, key."""
    return global_order(requests, [F.desc("kind"), F.desc("priority"), *[F.asc(c) for c in KEY]], rank="place")


def prefetch_children(requests: DataFrame) -> DataFrame:
    """The four finer tiles of each request above level 0, at a quarter of its priority."""
    kids = F.array(*[F.struct((F.col("y") * 2 + dy).alias("y"), (F.col("x") * 2 + dx).alias("x"))
                     for dy in (0, 1) for dx in (0, 1)])
    fine = requests.where(F.col("mip") > 0).select(
        "layer", (F.col("mip") - 1).alias("mip"), F.explode(kids).alias("k"),
        F.floor(F.col("priority") / 4).cast("int").alias("priority"), F.lit(0).alias("kind"), "frame")
    return fine.select("layer", "mip", "k.y", "k.x", "priority", "kind", "frame")


def with_prefetch(requests: DataFrame) -> DataFrame:
    own = requests.select(*KEY, "priority", "kind", "frame")
    return merge_requests(own.unionByName(prefetch_children(requests)))


def newest_batches(requests: DataFrame, keep: int = 3) -> DataFrame:
    """Requests of the newest ``keep`` frames of each layer.

    Only the distinct frames are ranked, and Spark keeps the top few per partition before the shuffle.
    """
    frames = requests.select("layer", "frame").distinct()
    rank = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("frame")))
    newest = frames.withColumn("batch", rank).where(F.col("batch") <= keep)
    return requests.join(newest, ["layer", "frame"])


def drop_stale(requests: DataFrame, max_age: int = 30) -> DataFrame:
    """Merged requests that are fresh, or that the newest frame of the layer still asks for."""
    merged = merge_requests(requests)
    now = requests.groupBy("layer").agg(F.max("frame").alias("_now"))
    return (merged.join(now, "layer").where(F.col("_now") - F.col("frame") <= max_age).drop("_now"))


def plan_eviction(store: DataFrame, need: DataFrame, budget: int, now_us: int, idle_us: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(verdict per need, evicted tiles): which tiles to drop so that ``need`` bytes fit each store.

    ``store`` is (store_id, key, bytes, last_used, pinned); ``need`` is (store_id, need_bytes).
    Candidates are unpinned and idle, oldest first and then by key; the shortest prefix that covers
    the missing bytes is dropped, or nothing when all of them would not do.
    """
    used = store.groupBy("store_id").agg(F.sum("bytes").alias("resident"))
    idle = (~F.col("pinned")) & (F.lit(now_us) - F.col("last_used") >= idle_us)
    loose = store.where(idle)
    free = loose.groupBy("store_id").agg(F.sum("bytes").alias("reclaimable"))
    state = (need.join(used, "store_id", "left").join(free, "store_id", "left")
             .na.fill(0, ["resident", "reclaimable"]))
    missing = F.greatest(F.lit(0), F.col("need_bytes") - F.greatest(F.lit(0), F.lit(budget) - F.col("resident")))
    verdict = (F.when(F.col("need_bytes") > budget, "oversized").when(missing == 0, "ready")
               .when(F.col("reclaimable") >= missing, "evict").otherwise("deferred"))
    state = state.withColumns({"missing": missing, "verdict": verdict})
    scanned = running(loose, ["store_id"], ["last_used", *KEY], None,
                      {"_before": ("sum", F.col("bytes"))}, inclusive=False)
    goal = state.where(F.col("verdict") == "evict").select("store_id", "missing")
    evicted = (scanned.join(goal, "store_id").where(F.coalesce("_before", F.lit(0)) < F.col("missing"))
               .select("store_id", *KEY, "bytes"))
    return state, evicted
