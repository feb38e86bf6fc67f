"""Times as text: strict UTC forms, ages, buckets, tick intervals and the simulation clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perigee.functions import constants as K


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def api_utc(value: Column | str) -> Column:
    """An ISO instant that ends in Z, with at most six digits of a second, to the millisecond (cut); else null."""
    v = F.trim(_c(value))
    ok = v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$")
    return F.date_format(F.when(ok, v).try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def store_timestamp(value: Column | str) -> Column:
    """An ISO instant with Z or an offset, in UTC to the microsecond; without a zone null."""
    v = F.trim(_c(value))
    ok = v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$")
    return F.date_format(F.when(ok, v).try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def form_utc(value: Column | str) -> Column:
    """``YYYY-MM-DDTHH:MM[:SS]`` of a form, read as UTC; else null."""
    v = F.trim(F.coalesce(_c(value), F.lit("")))
    ok = v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?$")
    return F.when(ok, F.concat(v, F.when(F.length(v) == 16, ":00Z").otherwise("Z"))).try_cast("timestamp")


def form_text(at: Column | str) -> Column:
    """What a form shows of an instant; empty where there is none."""
    return F.coalesce(F.date_format(_c(at), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def age_hours(at: Column | str, now: Column) -> Column:
    """Hours since an instant, not below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(_c(at))) / F.lit(3.6e9))


def is_recent(at: Column | str, hours: float, now: Column) -> Column:
    return F.coalesce(age_hours(at, now) < hours, F.lit(False))


def day_bucket(at: Column | str, now: Column) -> Column:
    """The UTC day; of ``now`` where there is no instant."""
    return F.date_format(F.coalesce(_c(at), now), "yyyy-MM-dd")


def advance(millis: Column, seconds: Column, warp: Column) -> Column:
    """The simulation clock after so many seconds: a minute a second times the warp; standing unless both are positive."""
    base = F.coalesce(millis.cast("double"), F.lit(0.0))
    moves = F.coalesce((seconds > 0) & (warp > 0), F.lit(False))
    return F.when(moves, base + seconds * 60000.0 * warp).otherwise(base)


# Intervals between ticks, by name and days.
TICK_DAYS = {"1 day": 1.0, "3 days": 3.0, "1 week": 7.0, "1 month": 30.0, "3 months": 90.0, "1 year": 365.25, "5 years": 1826.25, "10 years": 3652.5}


def tick_interval(range_ms: Column, width: Column | float, spacing: float = 120.0) -> Column:
    """The interval nearest to ``spacing`` pixels; of two equally near the shorter."""
    target = range_ms / (width if isinstance(width, Column) else F.lit(float(width))) * F.lit(spacing)
    tried = [F.struct(F.abs(F.lit(d * K.MS_DAY) - target).alias("off"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, d) in enumerate(TICK_DAYS.items())]
    return F.array_min(F.array(*tried))["name"]
