"""Time as microseconds since the epoch (UTC), free of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
# Width of a time chunk of ordered scans: ten minutes, so a decade has about half a million per key.
CHUNK_US = 600_000_000.0


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of a zone-free timestamp, read as UTC.

    Taken from the calendar fields, so the session zone plays no part.
    """
    t = col(ts)
    seconds = F.hour(t) * 3600 + F.minute(t) * 60
    fraction = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    return F.unix_date(t.cast("date")).cast("bigint") * F.lit(DAY_US) + seconds.cast("bigint") * 1_000_000 + fraction


def floor_to(t_us: Column | str, step_us: int, origin_us: int = 0) -> Column:
    """Start of the fixed window that holds ``t_us``."""
    t = col(t_us)
    return t - F.pmod(t - F.lit(origin_us), F.lit(step_us))


def day_number(t_us: Column | str) -> Column:
    """Whole days since the epoch, counted down for earlier times."""
    t = col(t_us)
    return ((t - F.pmod(t, F.lit(DAY_US))) / DAY_US).cast("int")


def civil_date(t_us: Column | str) -> Column:
    return F.date_from_unix_date(day_number(t_us))


def day_of_year(t_us: Column | str) -> Column:
    return F.dayofyear(civil_date(t_us))


def day_hours(t_us: Column | str) -> Column:
    """Hours since midnight, with fraction."""
    return F.pmod(col(t_us), F.lit(DAY_US)) / float(HOUR_US)


def iso_z(text: Column | str) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` as microseconds; NULL when it does not parse."""
    bare = F.regexp_replace(col(text), "Z$", "")
    stamp = F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    return micros(stamp)


def element_epoch(line: Column | str) -> Column:
    """Epoch of a first element line in microseconds: two-digit year (57 and up is 19yy) and day."""
    line = col(line)
    yy = F.substring(line, 19, 2).try_cast("int")
    day = F.substring(line, 21, 12).try_cast("double")
    year = F.when(yy >= 57, 1900 + yy).otherwise(2000 + yy)
    jan1 = F.unix_date(F.make_date(year, F.lit(1), F.lit(1))).cast("bigint")
    seconds = F.floor((day - 1.0) * 86400.0 + 0.5).cast("bigint")
    return F.when((day >= 1.0) & (day < 367.0), (jan1 * 86400 + seconds) * 1_000_000)


def age_label(valid_us: Column | str, now_us: Column | str) -> Column:
    """``future`` beyond an hour ahead, ``stale`` past 18 hours, else ``current``."""
    age = col(now_us) - col(valid_us)
    return (F.when(age < -HOUR_US, "future").when(age > 18 * HOUR_US, "stale").otherwise("current"))


def usable(observed_us: Column | str, now_us: Column | str, hours: float) -> Column:
    """True while an observation is nearer than the limit in time, either way."""
    return F.coalesce(F.abs(col(now_us) - col(observed_us)) < F.lit(int(hours * HOUR_US)), F.lit(False))
