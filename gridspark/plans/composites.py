"""Clear-sky composites: the darkest and warmest lately seen at each place, as ordered scans.

A stored composite relaxes by ``rate`` per hour between updates and takes the lower of itself and the
new value. With a clock ``u`` that adds the elapsed hours of every update, each step cut to 0-72, the
composite after update t is ``rate*u(t) + min over s <= t of (value(s) - rate*u(s))``: a running minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import solar
from ..functions.numeric import r6, smoothstep
from ..functions.timefn import DAY_US, HOUR_US, floor_to
from ..operators.ordered import running
from .masks import mask_counts

PLACE = ["y", "x"]
# Relaxation per hour, longest step, cosine that divides day from night.
VISIBLE_RATE, INFRARED_RATE, STEP_HOURS, DAY_COSINE = 0.004, 0.6, 72.0, 0.1
CHUNK_US = float(DAY_US)


def update_runs(obs: DataFrame) -> DataFrame:
    """The distinct update times, read from the time column alone."""
    return obs.select(floor_to("t_us", HOUR_US).alias("run_us")).distinct()


def update_clock(runs: DataFrame) -> DataFrame:
    """(run_us, u): hours of relaxation up to each update.

    There is one row per update of the whole system (at most 48 a day), so a decade is under 200 000 rows
    and one ordered window holds them.
    """
    order = Window.orderBy("run_us")
    hours = F.least(F.lit(STEP_HOURS), F.greatest(
        F.lit(0.0), (F.col("run_us") - F.lag("run_us").over(order)) / float(HOUR_US)))
    steps = runs.select("run_us").distinct().withColumn("_h", F.coalesce(hours, F.lit(0.0)))
    return steps.select("run_us", F.sum("_h").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("u"))


def hourly_fields(obs: DataFrame) -> DataFrame:
    """(run_us, y, x, albedo, ir, is_day, cosine, lat, u) from counts, with the update clock.

    The Sun is taken five minutes past the hour; its time terms are made once per update, on the clock.
    """
    masked = mask_counts(obs).withColumn("run_us", floor_to("t_us", HOUR_US))
    cells = masked.groupBy("run_us", *PLACE).agg(
        F.min(F.when(F.col("product") == "VIS", F.col("cnt"))).alias("vis"),
        F.min(F.when(F.col("product") == "LW", F.col("cnt"))).alias("ir"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    clock = solar.with_time_terms(update_clock(update_runs(obs)), F.col("run_us") + 5 * 60_000_000)
    cells = cells.join(clock, "run_us").withColumn("cosine", solar.zenith_cosine_of("sun_dec", "sun_minutes", "lat", "lon"))
    return cells.select("run_us", *PLACE, solar.albedo("vis", "cosine").alias("albedo"), "ir",
                        (F.col("cosine") > DAY_COSINE).alias("is_day"), "cosine", "lat", "u")


def composites(fields: DataFrame, by: list[str] = PLACE) -> DataFrame:
    """``fields`` (with the clock ``u``) plus vis_clear, ir_day and ir_night as they stand after each update."""
    u = F.col("u")
    day_ir = F.when(F.col("is_day"), F.col("ir"))
    night_ir = F.when(~F.col("is_day"), F.col("ir"))
    scans = {
        "_vis": ("min", F.col("albedo") - VISIBLE_RATE * u),
        "_day": ("min", day_ir - INFRARED_RATE * u),
        "_night": ("min", night_ir - INFRARED_RATE * u)}
    out = running(fields, by, ["run_us"], CHUNK_US, scans)
    return out.withColumns({
        "vis_clear": F.col("_vis") + VISIBLE_RATE * u, "ir_day": F.col("_day") + INFRARED_RATE * u,
        "ir_night": F.col("_night") + INFRARED_RATE * u}).drop("_vis", "_day", "_night", "u")


def update_state(state: DataFrame, fields: DataFrame, hours: float, by: list[str] = PLACE) -> DataFrame:
    """One update of a stored composite table (by, vis, ir_day, ir_night): a full outer join on the place."""
    h = min(max(hours, 0.0), STEP_HOURS)
    new = fields.select(*by, F.col("albedo").alias("_a"), F.when(F.col("is_day"), F.col("ir")).alias("_d"),
                        F.when(~F.col("is_day"), F.col("ir")).alias("_n"))
    both = state.join(new, by, "full_outer")
    return both.select(*by, F.least(F.col("vis") + VISIBLE_RATE * h, "_a").alias("vis"),
                       F.least(F.col("ir_day") + INFRARED_RATE * h, "_d").alias("ir_day"),
                       F.least(F.col("ir_night") + INFRARED_RATE * h, "_n").alias("ir_night"))


def cloudy_share(obs: DataFrame, rows: int = 2, cols: int = 3, threshold: float = 0.5) -> DataFrame:
    """Share of cloudy places per coarse cell and hour, against the clear-sky composites of each place.

    Visible brightening where the Sun is up, else infrared coldness.
    """
    fields = hourly_fields(obs)
    comp = composites(fields)
    surface = F.coalesce(F.least(F.col("vis_clear"), F.lit(0.45)), F.lit(0.12))
    visible = smoothstep(0.02, 0.45, F.col("albedo") - surface)
    infrared = smoothstep(16.0, 60.0, F.col("ir") - F.coalesce("ir_night", "ir_day"))
    seen = comp.withColumn("cloud", F.coalesce(visible, infrared)).where(F.col("cloud").isNotNull())
    return seen.groupBy(
        "run_us", F.floor(F.col("y") / rows).cast("int").alias("by"), F.floor(F.col("x") / cols).cast("int").alias("bx")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(F.col("cloud") > threshold, 1.0).otherwise(0.0))).alias("share"),
        r6(F.avg("cloud")).alias("mean_cloud"))
