"""As-of and latest-of joins, expressed as a union and an ordered scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str,
              right_cols: list[str], chunk_width: float, tolerance: int | None = None,
              tie: list[str] | None = None) -> DataFrame:
    """Each left row with the newest right row of its key at or before its time.

    ``tie`` names right columns that order right rows of equal time, the later one winning. Times are
    integers (microseconds). Beyond ``tolerance`` the match is dropped. Left rows are all kept.
    """
    tie = tie or []
    payload = F.struct(F.col(right_on).alias("_rt"), *right_cols)
    r = right.select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"),
                     (F.struct(*tie) if tie else F.struct(F.lit(0).alias("z"))).alias("_tie"),
                     payload.alias("_right"))
    lefts = F.struct(*[F.col(c) for c in left.columns])
    tie_type = r.schema["_tie"].dataType
    pay_type = r.schema["_right"].dataType
    l = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"),
                    F.lit(None).cast(tie_type).alias("_tie"), F.lit(None).cast(pay_type).alias("_right"),
                    lefts.alias("_left"))
    r = r.withColumn("_left", F.lit(None).cast(l.schema["_left"].dataType))
    both = l.unionByName(r)
    scanned = running(both, by, ["_t", "_side", "_tie"], chunk_width, {"_match": ("last", F.col("_right"))})
    hit = scanned.where(F.col("_side") == 1)
    if tolerance is not None:
        near = F.col("_t") - F.col("_match")["_rt"] <= F.lit(tolerance)
        hit = hit.withColumn("_match", F.when(near, F.col("_match")))
    return hit.select(*[F.col("_left")[c].alias(c) for c in left.columns],
                      *[F.col("_match")[c].alias(c) for c in dict.fromkeys([*right_cols])],
                      F.col("_match")["_rt"].alias("matched_at"))


def latest_step(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, right_cols: list[str],
                step: int, back: int) -> DataFrame:
    """Each left row with the newest right row at or before its time, for right rows that stand at multiples of ``step``.

    A match is at most ``back`` older. So it stands at one of a few times, and each is an equality join: nothing is ordered,
    and no key is in one task. ``right`` has one row of a key and time. Left rows are all kept.
    """
    last = F.col(left_on) - F.pmod(F.col(left_on), F.lit(step))
    payload = right.select(*by, F.col(right_on).alias("_at"), F.struct(F.col(right_on).alias("_t"), *right_cols).alias("_right"))
    out, matches = left, []
    for k in range(back // step + 1):
        out = out.withColumn("_at", last - k * step).join(payload.withColumnRenamed("_right", f"_m{k}"), [*by, "_at"], "left").drop("_at")
        matches.append(F.when(F.col(left_on) - (last - k * step) <= back, F.col(f"_m{k}")))
    out = out.withColumn("_match", F.coalesce(*matches))
    return out.select(*left.columns, *[F.col("_match")[c].alias(c) for c in right_cols], F.col("_match")["_t"].alias("matched_at"))


def latest_complete_cycle(messages: DataFrame, requests: DataFrame, required: list[str], cycles: int,
                          step_us: int, by: list[str] | None = None) -> DataFrame:
    """For each request time the newest of its last ``cycles`` cycles that holds every required field.

    ``messages`` is (by, cycle_us, name), ``requests`` is (by, request_id, now_us). Cycles are first
    reduced to the complete ones, and each request expands to its few candidate cycles, so the join
    is an equality on the cycle.
    """
    by = by or []
    complete = (messages.where(F.col("name").isin(required)).groupBy(*by, "cycle_us")
                .agg(F.count_distinct("name").alias("_n")).where(F.col("_n") == len(set(required))).drop("_n"))
    start = F.col("now_us") - F.pmod(F.col("now_us"), F.lit(step_us))
    wanted = requests.withColumn("cycle_us", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(cycles - 1)), lambda k: start - k.cast("bigint") * F.lit(step_us))))
    return (wanted.join(complete, [*by, "cycle_us"], "left_semi")
            .groupBy(*by, "request_id", "now_us").agg(F.max("cycle_us").alias("cycle_us")))


def first_available(candidates: DataFrame, present: DataFrame, key: list[str], by: list[str],
                    rank: str, value: str) -> DataFrame:
    """The lowest-ranked candidate that is present, per group."""
    hits = candidates.join(present.select(*key).distinct(), key, "left_semi")
    return hits.groupBy(*by).agg(F.min_by(value, rank).alias(value), F.min(rank).alias(rank))


def complete(parts: DataFrame, key: list[str], part: str, required: list) -> DataFrame:
    """The keys that hold every required part."""
    held = parts.where(F.col(part).isin(required)).groupBy(*key).agg(F.count_distinct(part).alias("_n"))
    return held.where(F.col("_n") == len(set(required))).drop("_n")


def month_ranks(month: Column, undated: bool = False) -> Column:
    """The twelve months by seasonal distance, the following month before the preceding one; month 0, undated, at the end."""
    def at(k):
        return F.pmod(month - 1 + k, F.lit(12)) + 1
    steps = [0]
    for d in range(1, 6):
        steps += [d, -d]
    steps.append(6)
    months = [at(k).cast("int") for k in steps] + [F.lit(0)] * undated
    return F.array(*[F.struct(F.lit(i).alias("rank"), m.alias("month")) for i, m in enumerate(months)])
