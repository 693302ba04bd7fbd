"""The domain frames as SQL, for the other side of each comparison."""

OBS = """obs as (
  select event_id, epoch_us(ts) as t_us, case when event_id % 2 = 0 then 'VIS' else 'LW' end as product,
    cast(floor((user_id % 150) / 15) as int) as y, cast(user_id % 15 as int) as x,
    90e0 - (floor((user_id % 150) / 15) + 0.5e0) * 18e0 as lat,
    -180e0 + (user_id % 15 + 0.5e0) * 24e0 as lon, value as cnt
  from events)"""

REQ = """req as (
  select event_id, epoch_us(ts) as t_us, 1 as layer, cast(user_id % 4 as int) as mip,
    cast(event_id % (case user_id % 4 when 0 then 8 when 1 then 4 when 2 then 2 else 1 end) as int) as x,
    cast(floor(event_id / 8) as int) % (case user_id % 4 when 0 then 4 when 1 then 2 else 1 end) as y,
    cast(floor(value) as int) as priority,
    case when event_type in ('view', 'click') then 1 else 0 end as kind,
    cast(floor(event_id / 10) as int) as frame
  from events)"""

IDX = """idx as (
  select file_id, line_no, name,
    cast(coalesce(sum(q) over (partition by file_id order by line_no
      rows between unbounded preceding and 1 preceding), 0) as bigint) as start_byte
  from (select l_orderkey as file_id, l_linenumber as line_no, min(l_returnflag) as name,
          min(cast(l_quantity as bigint)) * 1000 as q
        from lineitem group by l_orderkey, l_linenumber) t)"""

TEL = """tel as (
  select event_id, epoch_us(ts) as t_us, case when event_id % 2 = 0 then 'before' else 'after' end as run,
    event_type as scene, value as wait_ms
  from events)"""

ELE = """ele as (
  select user_id as object_id, epoch_us(ts) as epoch_us, event_id as element_id
  from events where event_type = 'click'),
ins as (
  select user_id as object_id, epoch_us(ts) as t_us, event_id as instant_id
  from events where event_type = 'error')"""

STARS = """stars as (
  select c_custkey as star_id, (c_custkey * 137.508e0) % 360e0 as ra,
    (c_custkey * 0.61803e0) % 180e0 - 90e0 as dec_deg,
    -2e0 + (c_acctbal + 1000e0) / 11000e0 * 10e0 as vmag, c_nationkey / 24e0 * 3e0 - 0.5e0 as bv,
    cast(c_custkey % 2001 as int) - 1000 as pm_ra, cast(c_custkey % 1501 as int) - 750 as pm_dec
  from customer)"""

GEN = """gen as (
  select o_custkey as product, epoch_us(o_orderdate) as gen_us, o_orderkey as file_id, o_orderpriority as name
  from orders)"""

CELLS = """cells as (
  select cast(floor(vec_id / 500) as int) as grid_id,
    cast(floor((vec_id % 500) / 25) * 8 + floor(i / 8) as int) as y,
    cast((vec_id % 25) * 8 + i % 8 as int) as x, v
  from (select vec_id, unnest(range(len(embedding))) as i, unnest(embedding)::double as v from embeddings) e)"""

BYTES = CELLS + """,
bytes as (
  select grid_id, y, x, r, (r * 3 + x) % 256 as g, (r * 5 + y) % 256 as b, (r * 7 + x + y) % 256 as a
  from (select grid_id, y, x, cast(least(255e0, greatest(0e0, round_even((v + 1e0) * 127.5e0, 0))) as int) as r from cells) q)"""

SKY = CELLS + """,
sky as (
  select grid_id, y, x,
    case when (x * 7 + y * 13) % 29 = 0 then null else least(1.2e0, greatest(0e0, 0.3e0 + v)) end as albedo,
    case when (x + y * 3) % 37 = 0 then null else 0.1e0 + (y % 9) * 0.05e0 end as vis_clear,
    case when (x * 5 + y * 3) % 31 = 0 then null else round_even(least(254e0, greatest(1e0, 120e0 + v * 250e0)), 0) end as ir,
    case when (x + y) % 23 = 0 then null else 60e0 + (x % 17) end as ir_night,
    case when (x + y) % 19 = 0 then null else 75e0 + (y % 13) end as ir_day,
    0.5e0 + v as model, 0.4e0 - v as low, (x % 100) / 100e0 as cosine
  from cells)"""


def with_(*views: str) -> str:
    return "with " + ",\n".join(views) + "\n"


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0e0)"


def step(e0, e1, x) -> str:
    """A smoothstep as SQL; NULL in gives NULL."""
    t = f"(case when ({x}) is null then null else greatest(0e0, least(1e0, (({x}) - ({e0})) / (({e1}) - ({e0})))) end)"
    return f"({t} * {t} * (3e0 - 2e0 * {t}))"


def clip(x, lo, hi) -> str:
    return f"(case when ({x}) is null then null else greatest({lo}, least({hi}, {x})) end)"


def linear(byte: str) -> str:
    s = f"(({byte}) / 255e0)"
    return f"(case when {s} <= 0.04045e0 then {s} / 12.92e0 else pow(({s} + 0.055e0) / 1.055e0, 2.4e0) end)"


def spread(band: str) -> str:
    """The weighted sum of the taps of a target; NULL unless all ``n`` of them are there."""
    return f"case when count({band}) = max(n) then sum({band} * w) end"


def srgb(x: str) -> str:
    c = f"greatest(0e0, least(1e0, {x}))"
    return f"(case when ({x}) is null then null when {c} <= 0.0031308e0 then {c} * 12.92e0 else 1.055e0 * pow({c}, 1e0 / 2.4e0) - 0.055e0 end)"


def solar(t: str) -> dict[str, str]:
    """Declination and equation of time of a microsecond column."""
    hours = f"((({t}) % 86400000000) / 3.6e9)"
    doy = f"dayofyear(make_timestamp({t}))"
    g = f"(2e0 * pi() / 365e0 * ({doy} - 1 + ({hours} - 12e0) / 24e0))"
    d2 = (f"0.006918e0 - 0.399912e0 * cos({g}) + 0.070257e0 * sin({g})"
          f" - 0.006758e0 * cos(2 * {g}) + 0.000907e0 * sin(2 * {g})")
    return {
        "hours": hours, "dec2": f"({d2})",
        "dec": f"({d2} - 0.002697e0 * cos(3 * {g}) + 0.00148e0 * sin(3 * {g}))",
        "eqt": (f"(229.18e0 * (0.000075e0 + 0.001868e0 * cos({g}) - 0.032077e0 * sin({g})"
                f" - 0.014615e0 * cos(2 * {g}) - 0.040849e0 * sin(2 * {g})))"),
    }


def cosz(t: str, lat: str, lon: str) -> str:
    s = solar(t)
    return (f"(sin(radians({lat})) * sin({s['dec']}) + cos(radians({lat})) * cos({s['dec']})"
            f" * cos(radians(({s['hours']} * 60e0 + {s['eqt']} + 4e0 * {lon}) / 4e0 - 180e0)))")
