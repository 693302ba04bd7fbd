"""The streaming operators, run over whole tables until the stream is closed."""

import uuid

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import numeric as N, timefn
from ..operators import requests as R, throttle
from ..session import checkpoint_root
from ..sinks.generations import read_generation
from ..plans import composites
from ..streaming import observations as O, refresh, requests as SR, runs, sources, telemetry as ST
from .fusion import COMPOSITES
from .registry import query
from .views import ELE, OBS, REQ, TEL, with_

HOUR = timefn.HOUR_US


def hours(spark, d):
    return A.observations(spark, d).withColumn("hour_us", timefn.floor_to("t_us", HOUR))


@query("i1_refresh_generations", "select event_type, count(*) as n, cast(sum(user_id) as bigint) as users from events group by 1")
def i1(spark, d):
    """One pass of the refresh loop over the table as a file stream, read back through the pointer."""
    schema = A.table(spark, d, "events").schema
    root = f"{checkpoint_root(spark)}/refresh-{uuid.uuid4().hex}"
    source = sources.file_stream(spark, f"{d}/events*.parquet", schema)
    build = lambda batch: batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
    run = refresh.refresh(source, build, f"{root}/store", f"{root}/checkpoint", every=None)
    run.awaitTermination()
    return read_generation(spark, f"{root}/store")


@query("i2_newest_pairs", with_(OBS) + """, h as (select y, x, max(t_us - t_us % 3600000000) filter (product = 'VIS')::bigint as vis_us, max(t_us - t_us % 3600000000) filter (product = 'LW')::bigint as ir_us from obs group by 1, 2)
select *, case when vis_us is not null and ir_us is not null then least(vis_us, ir_us) + 300000000 end as observed_us from h""")
def i2(spark, d):
    return O.newest_pairs(hours(spark, d), ["y", "x"])


@query("i2_strict_pairs", with_(OBS) + """, h as (select product, y, x, (t_us - t_us % 3600000000)::bigint as hour_us, max(cnt) as v from obs group by 1, 2, 3, 4)
select coalesce(a.y, b.y) as y, coalesce(a.x, b.x) as x, coalesce(a.hour_us, b.hour_us) as hour_us, a.v as vis, b.v as ir
from (select * from h where product = 'VIS') a full join (select * from h where product = 'LW') b on a.y = b.y and a.x = b.x and a.hour_us = b.hour_us""")
def i2b(spark, d):
    """Both products as streams of hourly fields, joined under two watermarks; lonely hours come out once."""
    def pairs(rows):
        obs = A.as_observations(rows, "time")
        best = lambda p: O.hourly_best(obs, ["y", "x"], F.when(F.col("product") == p, F.col("cnt"))).where("value is not null")
        return O.strict_pairs(best("VIS"), best("LW"), ["y", "x"])

    out, _ = runs.run_closed(A.event_stream(spark, d), "time", pairs)
    return out.select("y", "x", timefn.floor_to(F.unix_micros("at"), HOUR).alias("hour_us"), "vis", "ir")


def composite_run(spark, d):
    """The composite stream over all events, closed: its updates and its checkpoint."""
    clock = composites.update_clock(composites.update_runs(A.observations(spark, d)))
    return runs.run_closed(A.event_stream(spark, d), "time", lambda rows: O.composite_stream(
        O.field_rows(A.as_observations(rows, "time"), clock), A.OBS_W))


@query("i3_composite_stream", with_(OBS, COMPOSITES) + """select run_us, y, x, round(vis_clear, 6) + 0e0 as vis_clear,
  round(ir_day, 6) + 0e0 as ir_day, round(ir_night, 6) + 0e0 as ir_night from k""")
def i3(spark, d):
    """The composites of k1, kept as state of one row of the grid a key and released behind the watermark."""
    out, _ = composite_run(spark, d)
    return out.select("run_us", F.col("tile").cast("int").alias("y"), F.col("place").alias("x"),
                      *[N.r6(c).alias(c) for c in ("vis_clear", "ir_day", "ir_night")])


@query("i3_stored_composites", with_(OBS, COMPOSITES) + """, e as (select max(u) as now from r)
select y, x, round(min(albedo - 0.004e0 * u) + 0.004e0 * max(now), 6) + 0e0 as vis_clear,
  round(min(case when is_day then ir - 0.6e0 * u end) + 0.6e0 * max(now), 6) + 0e0 as ir_day,
  round(min(case when not is_day then ir - 0.6e0 * u end) + 0.6e0 * max(now), 6) + 0e0 as ir_night from k, e group by 1, 2""")
def i3b(spark, d):
    """The composites as the state store holds them after the last update, at the time of that update."""
    _, checkpoint = composite_run(spark, d)
    now = composites.update_clock(composites.update_runs(A.observations(spark, d))).agg(F.max("u").alias("now"), F.lit(0).alias("_k"))
    state = runs.stored_state(spark, checkpoint, "state")
    places = state.select(F.col("key.tile").cast("int").alias("y"), F.posexplode(F.arrays_zip("value.vis", "value.ir_day", "value.ir_night")).alias("x", "f"))
    seen = places.select("y", "x", "f.*", F.lit(0).alias("_k")).where("vis is not null or ir_day is not null or ir_night is not null")
    held = seen.join(F.broadcast(now), "_k")
    rates = (("vis", "vis_clear", composites.VISIBLE_RATE), ("ir_day", "ir_day", composites.INFRARED_RATE), ("ir_night", "ir_night", composites.INFRARED_RATE))
    return held.select("y", "x", *[N.r6(F.col(c) + rate * F.col("now")).alias(name) for c, name, rate in rates])


# Hours for which live clouds, aerosol and sea ice are used.
RETAINED_HOURS = {"clouds": 6.0, "aerosol": 24.0, "ice": 96.0}


@query("i4_retained_hours", """with p as (select case when event_type in ('view', 'click') then 'clouds' when event_type = 'error' then 'aerosol' else 'ice' end as product,
  user_id % 50 as place, epoch_us(ts) as t_us from events),
h as (select product, place, max(t_us - t_us % 3600000000)::bigint as hour_us from p group by 1, 2), n as (select max(t_us) as now_us from p)
select product, place, hour_us from h, n
where abs(now_us - hour_us) < 3600000000 * case product when 'clouds' then 6 when 'aerosol' then 24 else 96 end""")
def i4(spark, d):
    """The newest record of each product and place, from state whose entries expire, and usable at the time of the last event."""
    named = F.when(F.col("event_type").isin("view", "click"), "clouds").when(F.col("event_type") == "error", "aerosol").otherwise("ice")
    rows = A.event_stream(spark, d).select(named.alias("product"), (F.col("user_id") % 50).cast("bigint").alias("place"),
                                           timefn.floor_to("t_us", HOUR).alias("hour_us"))
    _, checkpoint = runs.run_available(O.retained_stream(rows, RETAINED_HOURS), "update")
    now = A.events(spark, d).agg(F.max("t_us").alias("now_us"), F.lit(0).alias("_k"))
    parts = []
    for product, hours in RETAINED_HOURS.items():
        state = runs.stored_state(spark, checkpoint, product)
        held = state.select("key.product", F.when(F.col("key.known"), F.col("key.place")).alias("place"), F.col("value.value.hour_us").alias("hour_us"), F.lit(0).alias("_k")).join(F.broadcast(now), "_k")
        parts.append(held.where(timefn.usable("hour_us", "now_us", hours)).select("product", "place", "hour_us"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("i5_six_hour_rollup", with_(TEL) + """select run, (t_us - t_us % 21600000000)::bigint as start_us, count(*) as n, round(avg(wait_ms), 9) + 0e0 as mean, max(wait_ms) as max from tel group by 1, 2""")
def i5(spark, d):
    t = A.events(spark, d).withColumn("run", F.when(F.col("event_id") % 2 == 0, "before").otherwise("after"))
    out = O.rollup_windows(t, ["run"], "value", "6 hours")
    return out.select("run", timefn.micros(F.col("window.start")).alias("start_us"), "n", F.round("mean", 9).alias("mean"), "max")


@query("i5_sliding_rollup", with_(TEL) + """, w as (select scene, wait_ms, (t_us - t_us % 1800000000 - k * 1800000000)::bigint as start_us from tel, (values (0), (1)) as q(k))
select scene, start_us, count(*) as n, round(avg(wait_ms), 9) + 0e0 as mean, max(wait_ms) as max from w group by 1, 2""")
def i5b(spark, d):
    t = A.events(spark, d).withColumn("scene", F.col("event_type"))
    out = O.rollup_windows(t, ["scene"], "value", "1 hour", "30 minutes")
    return out.select("scene", timefn.micros(F.col("window.start")).alias("start_us"), "n", F.round("mean", 9).alias("mean"), "max")


@query("i6_slow_sessions", with_(TEL) + """, s as (select *, case when t_us - lag(t_us) over (partition by scene order by t_us) <= 3600000000 then 0 else 1 end as b from tel where wait_ms >= 60),
g as (select *, sum(b) over (partition by scene order by t_us) as k from s)
select scene, min(t_us) as start_us, max(t_us) as last_us, count(*) as n, max(wait_ms) as worst from g group by scene, k""")
def i6(spark, d):
    def sessions(rows):
        t = rows.select(F.col("event_type").alias("scene"), "time", F.col("value").alias("wait_ms"))
        return ST.slow_sessions(t, ["scene"], 60, "1 hour", "time", "1 hour")

    out, _ = runs.run_closed(A.event_stream(spark, d), "time", sessions)
    return out.select("scene", F.unix_micros("session.start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n", "worst")


@query("i6_slow_runs", """with f as (select event_type as scene, value >= 60 as slow, epoch_us(ts) as t_us, event_id,
  sum(case when value >= 60 then 0 else 1 end) over (partition by event_type order by ts, event_id) as k,
  max(epoch_us(ts)) filter (value < 60) over (partition by event_type) as ends from events)
select scene, count(*) as length, min(t_us) as start, max(t_us) as "end" from f where slow and t_us < ends group by scene, k having count(*) >= 3""")
def i6b(spark, d):
    """Runs of three slow waits or more, closed by a fast one, released in order of time behind the watermark."""
    def slow(rows):
        return ST.slow_run_stream(rows.select(F.col("event_type").alias("key"), "time", "t_us", "event_id", (F.col("value") >= 60).alias("slow")))

    out, _ = runs.run_closed(A.event_stream(spark, d), "time", slow)
    return out.withColumnRenamed("key", "scene")


@query("i7_newest_batches", with_(REQ) + """, f as (select layer, frame, row_number() over (partition by layer order by frame desc) as batch from (select distinct layer, frame from req) q)
select r.event_id, r.layer, r.frame, f.batch::int as batch from req r join f on f.layer = r.layer and f.frame = r.frame where f.batch <= 3""")
def i7(spark, d):
    """Frames as the stream gives them out, one late; the newest three of each layer are kept."""
    timed = SR.with_frame_time(A.as_requests(A.event_stream(spark, d)))
    frames, _ = runs.run_closed(timed, "frame_ts", SR.frame_batches)
    kept = R.newest_batches(frames.select("layer", "frame")).select("layer", "frame", "batch")
    return A.requests(spark, d).join(kept, ["layer", "frame"]).select("event_id", "layer", "frame", "batch")


@query("i8_fresh_requests", with_(REQ) + """, m as (select layer, mip, y, x, max(priority) as priority, max(kind) as kind, max(frame) as frame from req group by 1, 2, 3, 4)
select m.* from m where (select max(frame) from req) - frame <= 30""")
def i8(spark, d):
    """The requests that the stale drop leaves in its state."""
    _, checkpoint = runs.run_available(SR.stale_stream(A.as_requests(A.event_stream(spark, d))))
    state = runs.stored_state(spark, checkpoint, "pending")
    return state.select("key.*", "value.*").select("layer", "mip", "y", "x", "priority", "kind", "frame")


@query("i9_in_flight_windows", with_(REQ) + """select floor(frame / 30)::int as window_no, layer, mip, y, x, max(priority) as priority, max(kind) as kind, max(frame) as frame, count(*) as merged from req group by 1, 2, 3, 4, 5""")
def i9(spark, d):
    timed = SR.with_frame_time(A.as_requests(A.event_stream(spark, d)))
    out, _ = runs.run_closed(timed, "frame_ts", lambda rows: SR.merged_windows(rows, lateness=1))
    return out


@query("i11_throttle_stream", with_(ELE).replace("with ", "with recursive ", 1) + """, made as (
  select object_id, min(t_us) as t_us from ins group by 1 union all
  select i.object_id, min(i.t_us) from made m join ins i on i.object_id = m.object_id and i.t_us >= m.t_us + 21600000000 group by 1)
select object_id, t_us, min(instant_id) as instant_id from ins join made using (object_id, t_us) group by 1, 2""")
def i11b(spark, d):
    """The attempts made, as the stream lets them through."""
    def attempts(rows):
        asked = rows.select(F.when(F.col("event_type") == "error", F.col("user_id")).alias("object_id"), "time", "t_us", "event_id")
        return ST.throttle_stream(asked, 6 * HOUR)

    out, _ = runs.run_closed(A.event_stream(spark, d), "time", attempts)
    return out.withColumnRenamed("event_id", "instant_id")


@query("i9_tiles_in_flight", with_(REQ) + "select distinct layer, mip, y, x from req")
def i9b(spark, d):
    """Tiles as they are sent: a repeat is not sent again while the first one may be on its way."""
    out, _ = runs.run_available(SR.in_flight(A.as_requests(A.event_stream(spark, d))).select("layer", "mip", "y", "x"))
    return out


@query("i11_throttled_refreshes", with_(ELE).replace("with ", "with recursive ", 1) + """, made as (
  select object_id, min(t_us) as t_us from ins group by 1 union all
  select i.object_id, min(i.t_us) from made m join ins i on i.object_id = m.object_id and i.t_us >= m.t_us + 21600000000 group by 1)
select object_id, t_us, min(instant_id) as instant_id from ins join made using (object_id, t_us) group by 1, 2""")
def i11(spark, d):
    return throttle.throttled(A.instants(spark, d), ["object_id"], "t_us", ["instant_id"], 6 * HOUR)
