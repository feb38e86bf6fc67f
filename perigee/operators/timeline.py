"""Launch and re-entry timelines, ticks, decay rules and catalog search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.functions import catalog as C
from perigee.functions import constants as K


def decay_date(value: Column | str) -> Column:
    """ISO or M/D/Y dates of the calendar; else null."""
    v = F.trim(F.col(value) if isinstance(value, str) else value)
    iso = F.when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(v, F.lit("yyyy-M-d")))
    us = F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(v, F.lit("M/d/yyyy")))
    return F.coalesce(iso, us).cast("date")


def launches(rows: DataFrame, date: str, now: Column | None = None, grace_days: int = 7) -> DataFrame:
    """Rows with a usable launch time; later than ``now`` plus the grace is dropped."""
    at = F.when(F.col(date) != "N/A", F.col(date)).try_cast("timestamp")
    out = rows.withColumn("launch_time", at).where("launch_time is not null")
    return out if now is None else out.where(F.col("launch_time") <= now + F.expr(f"interval {grace_days} days"))


def reentries(active: DataFrame, confirmed: DataFrame, key: str) -> DataFrame:
    """Active events and those confirmed ones whose object isn't among them; both have start and end."""
    newest = confirmed.groupBy(key).agg(F.max("start").alias("start")).withColumn("end", F.col("start")).withColumn("type", F.lit("CONFIRMED"))
    extra = newest.join(active.select(key).distinct(), key, "left_anti")
    return active.select(key, "start", "end", "type").unionByName(extra.select(key, "start", "end", "type"))


def bounds(events: DataFrame) -> DataFrame:
    """Start and end in milliseconds, each padded by the greater of 7 days and 5 %."""
    e = events.agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    pad = F.greatest(F.lit(float(K.MS_DAY * 7)), (F.col("hi") - F.col("lo")) * 0.05)
    return e.select((F.col("lo") - pad).alias("range_start"), (F.col("hi") + pad).alias("range_end"))


#: The limits of :func:`decay_candidate`.
LOW_KM, FAST_MOTION, FAST_PERIGEE_KM, DRAG_BSTAR, DRAG_PERIGEE_KM, DRAG_MOTION = 300.0, 15.8, 450.0, 0.0015, 450.0, 15.4


def decay_candidate(status: Column, klass: Column, perigee: Column, apogee: Column, altitude: Column, motion: Column, bstar: Column) -> Column:
    """Status words, then low orbits, then no for high classes, then fast or draggy low orbits."""
    no = F.lit(False)
    words = F.upper(F.coalesce(status, F.lit(""))).rlike("DECAY|RE-ENTRY|REENTRY")
    low = F.coalesce(perigee <= LOW_KM, no) | F.coalesce(altitude <= LOW_KM, no) | F.coalesce(apogee <= LOW_KM, no)
    high = F.upper(F.trim(F.coalesce(klass, F.lit("")))).isin("GEO", "MEO", "HEO", "HRO")
    fast = F.coalesce(motion >= FAST_MOTION, no) & (perigee.isNull() | (perigee <= FAST_PERIGEE_KM))
    near = F.coalesce(perigee <= DRAG_PERIGEE_KM, no) | F.coalesce(altitude <= DRAG_PERIGEE_KM, no) | F.coalesce(motion >= DRAG_MOTION, no)
    drag = F.coalesce(F.abs(bstar) >= DRAG_BSTAR, no) & near
    return F.when(words | low, True).when(high, False).otherwise(fast | drag)


def aligned_ticks(start: Column, end: Column, unit: str) -> Column:
    """Times aligned to a day, week, month or year from the first at or before ``start`` to ``end``."""
    step = {"day": "1 day", "week": "7 days", "month": "1 month", "year": "1 year"}[unit]
    return F.sequence(F.date_trunc(unit, start), end, F.expr(f"interval {step}"))


def search(rows: DataFrame, query: str, fields: list[str], order: list[str], limit: int = 40, preview: int = 12) -> DataFrame:
    """Rows whose lower-cased fields contain the query, in order; a blank query previews the first few."""
    q = query.strip().lower()
    if not q:
        return rows.orderBy(*order).limit(min(preview, limit))
    return rows.where(F.contains(C.search_text(*fields), F.lit(q))).orderBy(*order).limit(limit)


def grouped_names(rows: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """Records by name with a sorted list of structs, as a decayed-objects file holds them."""
    return rows.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("records"), F.count("*").alias("n"))
