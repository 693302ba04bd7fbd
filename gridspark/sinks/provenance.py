"""Provenance records: what a pack was made of, under one digest that every asset can be checked against.

The digest of a pack is the root of a hash tree over its assets, sorted by name. Level by level, ``FAN`` neighbours become the
hash of their hashes, so each level is one aggregate over groups of bounded size, and a pack of n assets takes log n of them. An
asset is proved by its neighbours on each level, without the other assets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running
from ..session import cut_lineage

FAN = 16


def leaf(name: Column, sha256: Column, size: Column) -> Column:
    """Hash of an asset's name, content hash and size; NULLs read as empty."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("\n", part(name), part(sha256), part(size)), 256)


def hash_tree(assets: DataFrame, by: list[str], name: str = "name", sha256: str = "sha256", size: str = "bytes") -> DataFrame:
    """(by, level, pos, hash, n): all nodes of each pack's tree; ``n`` is the number of nodes on the level.

    Assets are sorted by name and leaf hash. Positions come from an ordered scan, so no pack is in one task.
    """
    leaves = assets.select(*by, F.col(name).alias("_name"), leaf(F.col(name), F.col(sha256), F.col(size)).alias("hash"))
    # Equal assets have equal hashes, so any order among them gives the same tree.
    same = leaves.groupBy(*by, "_name", "hash").agg(F.count(F.lit(1)).alias("_many"))
    placed = running(same, by, ["_name", "hash"], None, {"_before": ("sum", F.col("_many"))}, inclusive=False)
    first = F.coalesce("_before", F.lit(0)).cast("bigint")
    spread = placed.select(*by, "hash", F.explode(F.sequence(first, first + F.col("_many") - 1)).alias("pos"))
    counted = spread.join(spread.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    level = cut_lineage(counted.select(*by, F.lit(0).alias("level"), "pos", "hash", "n"))
    tree, height = level, 0
    while not level.where("n > 1").isEmpty():
        height += 1
        groups = level.where("n > 1").groupBy(*by, F.floor(F.col("pos") / FAN).alias("_up"), "n").agg(
            F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("_kids"))  # FAN at most
        level = cut_lineage(groups.select(
            *by, F.lit(height).alias("level"), F.col("_up").alias("pos"),
            F.sha2(F.array_join(F.transform("_kids", lambda k: k["hash"]), ""), 256).alias("hash"),
            F.floor((F.col("n") + FAN - 1) / FAN).alias("n")))
        tree = tree.unionByName(level)
    return tree


def provenance(assets: DataFrame, by: list[str], tree: DataFrame | None = None, credit: str | None = None) -> DataFrame:
    """One record per pack: files, bytes, the digest, and a credit line of its assets where ``credit`` names a column."""
    tree = hash_tree(assets, by) if tree is None else tree
    sums = [F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")]
    if credit:
        sums.append(F.min(credit).alias("credit"))
    roots = tree.where("n = 1").groupBy(*by).agg(F.max_by("hash", "level").alias("digest"))
    return assets.groupBy(*by).agg(*sums).join(roots, by)


def proofs(tree: DataFrame, by: list[str], leaves: DataFrame) -> DataFrame:
    """(by, pos, path): for each leaf position the hashes beside it, level by level, as (level, place, hashes) structs."""
    kids = tree.where("n > 1").groupBy(*by, "level", F.floor(F.col("pos") / FAN).alias("_group")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda k: k["hash"]).alias("hashes"))
    heights = tree.groupBy(*by).agg(F.max("level").alias("_top"))
    asked = leaves.select(*by, "pos").join(heights, by).withColumn("level", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_top") - 1, F.lit(0)))))
    at = F.floor(F.col("pos") / F.pow(F.lit(float(FAN)), "level")).cast("bigint")
    steps = asked.withColumn("_at", at).withColumn("_group", F.floor(F.col("_at") / FAN)).join(kids, [*by, "level", "_group"], "left")
    return steps.groupBy(*by, "pos").agg(F.array_sort(F.collect_list(F.when(
        F.col("hashes").isNotNull(), F.struct("level", (F.col("_at") % FAN).cast("int").alias("place"), "hashes")))).alias("path"))


def proven(leaf_hash: Column, path: Column, digest: Column) -> Column:
    """Whether a leaf at the places of its path leads to the digest of its pack."""
    def up(held, step):
        right = F.element_at(step["hashes"], step["place"] + 1) == held
        return F.when(right, F.sha2(F.array_join(step["hashes"], ""), 256))
    return F.coalesce(F.aggregate(path, leaf_hash, up) == digest, F.lit(False))


def write_provenance(assets: DataFrame, by: list[str], path: str, credit: str | None = None, notes: tuple[str, ...] = ()) -> None:
    """Assets one line each, and a record for each pack with its notes."""
    assets.write.mode("overwrite").partitionBy(*by).json(f"{path}/assets")
    record = provenance(assets, by, credit=credit).withColumn("notes", F.array(*[F.lit(n) for n in notes]).cast("array<string>"))
    record.write.mode("overwrite").json(f"{path}/packs")
