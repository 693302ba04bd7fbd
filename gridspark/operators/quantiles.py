"""Exact percentiles and weighted percentiles without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, small


# Bits of an order key that one selection pass looks at.
DIGIT, PASSES = 16, 4


def order_key(value: Column) -> Column:
    """A 64-bit integer for each double, in the same order: sign, exponent and fraction, found by exact arithmetic.

    NULL for NULL and NaN; both zeros have the key 0.
    """
    v = value.cast("double")
    size = F.abs(v)
    guess = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size))).cast("int")
    power = F.pow(F.lit(2.0), guess.cast("double"))
    exponent = guess - (power > size).cast("int") + (power * 2.0 <= size).cast("int")  # the logarithm may round across
    fraction = (size / F.pow(F.lit(2.0), exponent.cast("double")) - 1.0) * float(1 << 52)
    normal = (exponent + 1023).cast("bigint") * F.lit(1 << 52) + fraction.cast("bigint")
    tiny = (size * 2.0 ** 537 * 2.0 ** 537).cast("bigint")  # in units of the least double
    key = F.when(size < 2.0 ** -1022, tiny).when(size == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(F.isnan(v), None).when(v < 0, -key).otherwise(key)


def exact_percentiles(df: DataFrame, by: list[str], value: Column | str, qs: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per group, one column per entry of ``qs``; NULL and NaN count as missing.

    Radix selection: every value has an order key of 64 bits. A pass counts the rows of each group by the next 16 bits of
    their keys, with partial sums before the shuffle, and the running count over these bins, at most 65 536 of a group,
    says which bin holds a wanted rank. Only rows of such bins are looked at again; a rank is settled when its bin
    holds one value, after four passes at the latest. So no values are ever sorted, and a group of any size is spread over
    all tasks.
    """
    value = F.col(value) if isinstance(value, str) else value
    if not by:
        whole = exact_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, qs)
        return whole.drop("_all")
    rows = df.select(*by, value.alias("_v")).withColumn("_key", order_key(F.col("_v"))).where(F.col("_key").isNotNull())
    names, settled, wanted = list(qs), None, None
    for step in range(PASSES):
        place = F.shiftright("_key", 64 - DIGIT * (step + 1))
        bins = rows.groupBy(*by, place.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        above = F.shiftright("_bin", DIGIT) if step else F.lit(0).cast("bigint")
        bins = bins.withColumn("_above", above)
        inside = Window.partitionBy(*by, "_above")
        upto = inside.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
        if step == 0:
            # The ranks on both sides of each position, and the share of the upper one.
            n = F.sum("_c").over(inside) - 1
            ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank(n * F.lit(float(q))).cast("bigint").alias("rank"),
                                      (n * F.lit(float(q)) - F.floor(n * F.lit(float(q)))).alias("share"))
                             for i, q in enumerate(qs.values()) for side, rank in ((0, F.floor), (1, F.ceil))])
            found = bins.withColumn("_all_ends", ends).withColumn("_w", F.explode("_all_ends")).select(
                *by, "_bin", "_lo", "_hi", "_start", "_end", F.col("_w.i").alias("_i"), F.col("_w.side").alias("_side"),
                F.col("_w.rank").alias("_rank"), F.col("_w.share").alias("_share"))
        else:
            found = bins.join(wanted, [*by, "_above"])
        found = found.where((F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_end"))).select(
            *by, "_i", "_side", "_share", (F.col("_rank") - F.col("_start")).alias("_rank"), "_bin", "_lo", "_hi")
        found = cut_lineage(found)
        done = found.where("_lo = _hi").select(*by, "_i", "_side", "_share", "_lo")
        settled = done if settled is None else settled.unionByName(done)
        wanted = found.where("_lo <> _hi").select(*by, "_i", "_side", "_share", "_rank", F.col("_bin").alias("_above"))
        left = wanted.select(*by, "_above").distinct()
        count = left.count()
        if not count:
            break
        rows = rows.withColumn("_above", place).join(small(left, count), [*by, "_above"], "left_semi").drop("_above")
        if step == 0:
            rows = cut_lineage(rows)  # what is left of the table, read by the later passes
    at = lambda i, side: F.max(F.when((F.col("_i") == i) & (F.col("_side") == side), F.col("_lo")))
    share = lambda i: F.max(F.when(F.col("_i") == i, F.col("_share")))
    return settled.groupBy(*by).agg(*[
        (at(i, 0) + (at(i, 1) - at(i, 0)) * share(i)).alias(name) for i, name in enumerate(names)])


def histogram_percentile(df: DataFrame, by: list[str], value: str, q: float, out: str) -> DataFrame:
    """Linear-interpolated percentile of a field of few distinct values (counts, bytes).

    The field is first reduced to one row per group and value.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    order = w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = hist.select("*", F.sum("_c").over(order).alias("_end"), F.sum("_c").over(w).alias("_n"))
    pos = (F.col("_n") - 1) * F.lit(float(q))
    start = F.col("_end") - F.col("_c")

    def at(rank):
        return F.max(F.when((start <= rank) & (rank < F.col("_end")), F.col("_v")))

    lower = F.floor(pos)
    return (placed.groupBy(*by).agg(at(lower).alias("_lo"), at(F.ceil(pos)).alias("_hi"), F.max(pos - lower).alias("_f"))
            .select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(out)))


def weighted_percentile(df: DataFrame, by: list[str], value: str, weight: str, ps: dict[str, float | Callable[[Column], Column]],
                        bins: int = 256) -> DataFrame:
    """First value whose cumulative weight reaches ``p`` of the group's total, per entry of ``ps``; or p(total) for a function.

    Weights are integers, so the cumulative sums are exact in any order. Each group is reduced to a
    weight per distinct value, and to ``bins`` value ranges; only the range a crossing falls in is
    ordered by value.
    """
    base = (df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v"))
            .agg(F.sum(weight).cast("bigint").alias("_w")))
    span = base.groupBy(*by).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.sum("_w").alias("_total"))
    binned = base.join(span, by).withColumn("_bin", F.when(
        F.col("_max") > F.col("_min"),
        F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_min")) / (F.col("_max") - F.col("_min")) * bins)))
        .otherwise(F.lit(0)))
    per_bin = binned.groupBy(*by, "_bin").agg(F.sum("_w").alias("_bw"), F.max("_total").alias("_total"))
    order = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    ranged = (per_bin.withColumn("_bend", F.sum("_bw").over(order))
              .withColumn("_bstart", F.col("_bend") - F.col("_bw")))
    names = list(ps)
    total = F.col("_total")
    targets = F.array(*[F.struct(F.lit(i).alias("i"), (p(total) if callable(p) else F.lit(float(p)) * total).cast("double").alias("goal"))
                        for i, p in enumerate(ps.values())])
    crossing = (ranged.withColumn("_t", F.explode(targets))
                .where((F.col("_bend") >= F.col("_t.goal")) & (F.col("_bstart") < F.col("_t.goal")))
                .select(*by, "_bin", "_bstart", F.col("_t.goal").alias("_goal"), F.col("_t.i").alias("_i")))
    inside = binned.join(crossing, [*by, "_bin"])
    rows = Window.partitionBy(*by, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    met = inside.withColumn("_cum", F.col("_bstart") + F.sum("_w").over(rows)).where(F.col("_cum") >= F.col("_goal"))
    first = met.groupBy(*by, "_i").agg(F.min("_v").alias("_p"))
    return first.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_p"))).alias(n) for i, n in enumerate(names)])
