"""Observation products: pairing, decaying composites, retention and roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import solar
from ..functions.timefn import HOUR_US, floor_to
from ..plans.composites import DAY_COSINE, INFRARED_RATE, VISIBLE_RATE
from ..plans.masks import mask_counts
from .ordering import InOrder, seen_by_watermark

LATENESS = "2 hours"


def newest_pairs(products: DataFrame, by: list[str]) -> DataFrame:
    """The newest hour of each product, paired although they may differ; works on a batch or a stream.

    ``products`` is (by, product, hour_us). The pair is observed five minutes past the earlier hour. As a
    stream it keeps one small row per key (update or complete mode).
    """
    vis = F.max(F.when(F.col("product") == "VIS", F.col("hour_us")))
    ir = F.max(F.when(F.col("product") == "LW", F.col("hour_us")))
    newest = products.groupBy(*by).agg(vis.alias("vis_us"), ir.alias("ir_us"))
    both = F.col("vis_us").isNotNull() & F.col("ir_us").isNotNull()
    return newest.withColumn("observed_us", F.when(both, F.least("vis_us", "ir_us") + 5 * 60_000_000))


def strict_pairs(vis: DataFrame, ir: DataFrame, by: list[str], within: str = "0 seconds") -> DataFrame:
    """Both products of the same time, and each that has no partner: an outer join of two streams.

    Both are (by, ``at`` TIMESTAMP under a watermark, value). An infrared field belongs to the visible one that is at
    most ``within`` older; when the watermark has passed that range, what is still alone comes out once, with NULL for
    the other side, and its state goes. Rows with a NULL in ``by`` have no partner.
    """
    a = vis.select(*[F.col(c).alias("_a_" + c) for c in by], F.col("at").alias("_a_at"), F.col("value").alias("vis"))
    b = ir.select(*[F.col(c).alias("_b_" + c) for c in by], F.col("at").alias("_b_at"), F.col("value").alias("ir"))
    same = F.expr(f"_b_at >= _a_at and _b_at <= _a_at + interval {within}")
    for c in by:
        same = (F.col("_a_" + c) == F.col("_b_" + c)) & same
    both = a.join(b, same, "full_outer")
    return both.select(*[F.coalesce("_a_" + c, "_b_" + c).alias(c) for c in by], F.coalesce("_a_at", "_b_at").alias("at"), "vis", "ir")


def hourly_best(products: DataFrame, by: list[str], value: str, lateness: str = LATENESS) -> DataFrame:
    """(by, at, value): the largest value of each key and hour, once the watermark has passed the hour.

    ``products`` has ``time`` as a TIMESTAMP; ``at`` is the last moment of the hour, and carries the watermark on.
    """
    hours = products.withWatermark("time", lateness).groupBy(F.window("time", "1 hour"), *by).agg(F.max(value).alias("value"))
    return hours.select(*by, F.window_time("window").alias("at"), "value")


class CompositeState(InOrder):
    """Clear-sky composites of one tile: three arrays over its places, each value less what the clock adds to it.

    An update relaxes a composite by a rate times the hours ``u`` on the update clock, so the least of value - rate * u
    is all that has to be kept; NULL stands for a place not seen yet.
    """

    columns = "t_us bigint, u double, place int, albedo double, ir double, is_day boolean"
    remembered = "vis array<double>, ir_day array<double>, ir_night array<double>"
    keys = ("tile",)

    def __init__(self, places: int):
        self.places = places

    def fold(self, rows: pd.DataFrame, passed: int) -> pd.DataFrame:
        if self.state.exists():
            fields = [np.array([np.nan if v is None else v for v in a], float) for a in self.state.get()]
        else:
            fields = [np.full(self.places, np.nan) for _ in range(3)]
        rates, out = (VISIBLE_RATE, INFRARED_RATE, INFRARED_RATE), []
        for run_us, part in rows.groupby("t_us"):  # one update
            u, place = float(part["u"].iloc[0]), part["place"].to_numpy(int)
            day, ir = part["is_day"].to_numpy(bool), part["ir"].to_numpy(float)
            seen = (part["albedo"].to_numpy(float), np.where(day, ir, np.nan), np.where(day, np.nan, ir))
            for field, rate, values in zip(fields, rates, seen):
                np.fmin.at(field, place, values - rate * u)
            place = np.unique(place)
            out.append(pd.DataFrame({"run_us": int(run_us), "place": place, **{
                name: field[place] + rate * u for name, field, rate in zip(("vis_clear", "ir_day", "ir_night"), fields, rates)}}))
        self.state.update(tuple([None if np.isnan(v) else float(v) for v in f] for f in fields))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame()


COMPOSITE_SCHEMA = "tile bigint, run_us bigint, place int, vis_clear double, ir_day double, ir_night double"


def composite_stream(fields: DataFrame, places: int, lateness: str = LATENESS) -> DataFrame:
    """Composites after every update, for a stream of (tile, time TIMESTAMP, t_us, u, place, albedo, ir, is_day).

    ``t_us`` is the time of the update and ``time`` the same as a TIMESTAMP; of several rows of a place the least
    counts. State is one row per tile of at most a few thousand places, kept in RocksDB, and the rows that wait.
    """
    rows = fields.withWatermark("time", lateness).where(seen_by_watermark("time", F.col("tile").isNotNull()))
    made = rows.groupBy("tile").transformWithStateInPandas(
        statefulProcessor=CompositeState(places), outputStructType=COMPOSITE_SCHEMA, outputMode="Append", timeMode="EventTime")
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("vis_clear", "ir_day", "ir_night")})


def field_rows(obs: DataFrame, clock: DataFrame) -> DataFrame:
    """(time, tile, place, t_us, u, albedo, ir, is_day) of a stream of observations: a tile is a row of the grid.

    ``clock`` is the table (run_us, u) of updates, one row each, with the Sun's terms made once per update.
    """
    masked = mask_counts(obs).withColumn("run_us", floor_to("t_us", HOUR_US))
    lit = solar.with_time_terms(clock, F.col("run_us") + 5 * 60_000_000)
    rows = masked.join(lit, "run_us", "left").withColumn("cosine", solar.zenith_cosine_of("sun_dec", "sun_minutes", "lat", "lon"))
    one = lambda product: F.when(F.col("product") == product, F.col("cnt"))
    return rows.select(
        F.coalesce(F.timestamp_micros("run_us"), "time").alias("time"), F.col("y").cast("bigint").alias("tile"), F.col("x").alias("place"),
        F.col("run_us").alias("t_us"), "u", solar.albedo(one("VIS"), F.col("cosine")).alias("albedo"), one("LW").alias("ir"),
        (F.col("cosine") > DAY_COSINE).alias("is_day"))


class Retained(StatefulProcessor):
    """The newest time of a product, forgotten when nothing has come for as long as it may be used.

    Each product has a state of its own, for state has one time to live.
    """

    def __init__(self, hours: dict[str, float]):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = {p: handle.getValueState(p, "hour_us bigint", ttlDurationMs=int(h * 3_600_000)) for p, h in self.hours.items()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.newest.get(key[0])
        if state is None:
            return
        newest = max(int(part["hour_us"].max()) for part in rows if len(part))
        if state.exists():
            newest = max(newest, state.get()[0])
        state.update((newest,))
        yield pd.DataFrame({"product": [key[0]], "place": [key[1] if key[2] else None], "hour_us": [newest]})

    def close(self) -> None:
        pass


def retained_stream(products: DataFrame, hours: dict[str, float]) -> DataFrame:
    """Updates of the newest usable record of a stream of (product, place, hour_us), with ``hours`` to live by product.

    The time to live is processing time and starts anew with each update; other products are not kept, nor records without
    an hour. Records without a place are those of one place more: in the key of the state it is 0 and not ``known``.
    """
    dated = products.where("product is not null and hour_us is not null").select(
        "product", F.coalesce("place", F.lit(0)).alias("place"), F.col("place").isNotNull().alias("known"), "hour_us")
    return dated.groupBy("product", "place", "known").transformWithStateInPandas(
        statefulProcessor=Retained(hours), outputStructType="product string, place bigint, hour_us bigint",
        outputMode="Update", timeMode="ProcessingTime")


def first_of_hour(products: DataFrame, by: list[str], lateness: str = LATENESS) -> DataFrame:
    """One record per key and hour; repeats that arrive within the lateness are dropped, and state expires.

    ``products`` carries ``hour`` as a TIMESTAMP.
    """
    return products.withWatermark("hour", lateness).dropDuplicatesWithinWatermark([*by, "hour"])


def rollup_windows(rows: DataFrame, by: list[str], value: str, size: str, slide: str | None = None,
                   time: str = "ts", lateness: str | None = None) -> DataFrame:
    """Count, mean and maximum per tumbling or sliding window; a stream gives ``lateness``."""
    if lateness:
        rows = rows.withWatermark(time, lateness)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
