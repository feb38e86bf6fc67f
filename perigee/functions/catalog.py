"""Column functions over catalog fields: element sets, identities, classes, freshness."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from perigee.functions import constants as K


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _case(pairs: dict[str, tuple[str, ...]], value: Column, other: str) -> Column:
    out = None
    for result, spellings in pairs.items():
        out = (F if out is None else out).when(value.isin(*spellings), result)
    return out.otherwise(other)


# element sets --------------------------------------------------------------


def tle_checksum(line: Column | str) -> Column:
    """Digits of the first 68 characters added up, each minus counting one, modulo ten; null if shorter."""
    body = F.substring(_c(line), 1, 68)
    total = F.lit(0)
    for d in range(1, 10):
        total = total + d * (F.length(body) - F.length(F.replace(body, F.lit(str(d)), F.lit(""))))
    total = total + F.length(body) - F.length(F.replace(body, F.lit("-"), F.lit("")))
    return F.when(F.length(_c(line)) >= 68, total % 10).cast("int")


def tle_norad(line1: Column | str) -> Column:
    line = _c(line1)
    return F.when(F.length(line) >= 7, F.trim(F.substring(line, 3, 5))).otherwise(K.NO_DATA)


def loose_pair(line1: Column | str, line2: Column | str) -> Column:
    """Whether two lines look like one element set: prefixes, and the number of line 1 begins that of line 2."""
    one, two = _c(line1), _c(line2)
    a = tle_norad(one)
    b = F.regexp_replace(F.coalesce(F.try_element_at(F.split(F.trim(two), r"\s+"), F.lit(2)), F.lit("")), r"\D", "")
    return F.coalesce(one.startswith("1 ") & two.startswith("2 ") & (F.length(a) > 0) & (F.length(b) > 0) & b.startswith(a), F.lit(False))


def implied_eccentricity(token: Column | str) -> Column:
    digits = F.regexp_replace(_c(token), "[^0-9]", "")
    return F.when(F.length(digits) > 0, F.concat(F.lit("0."), digits).try_cast("double"))


def exponent_field(token: Column | str) -> Column:
    """Fixed-width ``±ddddd±d``: a mantissa with implied point times a power of ten."""
    t = _c(token)
    part = lambda i: F.regexp_extract(t, r"^([ +\-])(\d{5})([+\-]\d)$", i)
    value = F.concat(F.lit("0."), part(2)).try_cast("double") * F.pow(F.lit(10.0), part(3).try_cast("double"))
    return F.when(t.rlike(r"^[ +\-]\d{5}[+\-]\d$"), F.when(part(1) == "-", -value).otherwise(value))


def metrics_from(mean_motion: Column, eccentricity: Column) -> dict[str, Column]:
    """Period, axis and altitudes of a mean motion (revolutions a day); null unless it is positive."""
    n = F.when(mean_motion > 0, mean_motion)
    e = F.coalesce(eccentricity, F.lit(0.0))
    rate = n * (2.0 * math.pi) / 86400.0
    axis = F.pow(F.lit(K.EARTH_MU_KM3_S2) / (rate * rate), F.lit(1.0 / 3.0))
    low, high = axis * (1.0 - e) - K.EARTH_RADIUS_KM, axis * (1.0 + e) - K.EARTH_RADIUS_KM
    return {"period_min": K.MINUTES_PER_DAY / n, "semi_major_axis_km": axis, "perigee_km": low, "apogee_km": high, "estimated_altitude_km": (low + high) / 2.0}


def orbit_metrics(line2: Column | str) -> dict[str, Column]:
    """Fields and derived sizes of line 2; all null with fewer than eight tokens."""
    tokens = F.split(F.trim(_c(line2)), r"\s+")
    at = lambda i: F.when(F.size(tokens) >= 8, F.try_element_at(tokens, F.lit(i)))
    inclination, eccentricity, motion = at(3).try_cast("double"), implied_eccentricity(at(5)), at(8).try_cast("double")
    return {"inclination_deg": inclination, "eccentricity": eccentricity, "mean_motion_rev_per_day": motion, **metrics_from(motion, eccentricity)}


def orbit_class_ingest(mean_motion: Column, eccentricity: Column, perigee: Column, apogee: Column) -> Column:
    """The class that ingestion assigns.  The viewer's rules differ: see :func:`orbit_class_viewer`."""
    return (
        F.when(mean_motion.isNull(), K.NO_DATA)
        .when(perigee < 120, "DECAYING")
        .when((F.coalesce(eccentricity, F.lit(0.0)) > 0.25) | F.coalesce(apogee > 50000, F.lit(False)), "HEO")
        .when(mean_motion < 2.5, "GEO")
        .when(mean_motion > 11.0, "LEO")
        .otherwise("MEO")
    )


def orbit_class_viewer(mean_motion: Column, eccentricity: Column | None = None, inclination: Column | None = None, period: Column | None = None, altitude: Column | None = None) -> Column:
    e = F.greatest(F.coalesce(eccentricity if eccentricity is not None else F.lit(None), F.lit(0.0)), F.lit(0.0))
    i = F.abs(F.coalesce(inclination if inclination is not None else F.lit(None), F.lit(0.0)))
    given = period if period is not None else F.lit(None).cast("double")
    p = F.coalesce(F.when(given > 0, given), F.try_divide(F.lit(1440.0), mean_motion))
    out = (
        F.when(mean_motion.isNull() | F.isnan(mean_motion) | (mean_motion <= 0), "UNKNOWN")
        .when((F.abs(p - 1436.1) <= 90) & (i <= 15) & (e < 0.08), "GEO")
        .when((e >= 0.25) | ((p >= 600) & (p <= 900) & (i >= 50) & (i <= 75)) | ((e >= 0.12) & (p > 225)), "HEO")
    )
    if altitude is not None:
        out = out.when(altitude < 2000, "LEO").when(altitude < 35786, "MEO").when(altitude.isNotNull(), "OTHER")
    return out.when(mean_motion > 11, "LEO").when(mean_motion >= 2.5, "MEO").otherwise("OTHER")


def tle_epoch(line1: Column | str) -> Column:
    """Epoch of line 1, to the microsecond; two-digit years under 57 lie in this century."""
    line = _c(line1)
    yy, day = F.substring(line, 19, 2).try_cast("int"), F.substring(line, 21, 12).try_cast("double")
    year = F.when(yy < 57, 2000 + yy).otherwise(1900 + yy)
    start = F.unix_micros(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    return F.when(F.length(line) >= 32, F.timestamp_micros(start + F.round((day - 1) * 86400.0 * 1e6).cast("long")))


def strict_epoch(field: Column | str) -> Column:
    """``YYDDD.dddddddd`` with the day inside its year, to the millisecond; else null."""
    f = _c(field)
    yy, day = F.substring(f, 1, 2).try_cast("int"), F.substring(f, 3, 12).try_cast("double")
    year = F.when(yy >= 57, 1900 + yy).otherwise(2000 + yy)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    ok = f.rlike(r"^\d{5}\.\d{8}$") & (day >= 1) & (day < F.when(leap, 367).otherwise(366))
    start = F.unix_millis(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    return F.when(ok, F.timestamp_millis(start + F.floor((day - 1) * K.MS_DAY).cast("long")))


# vocabularies and identities ----------------------------------------------


def object_type(value: Column | str) -> Column:
    return _case(K.TYPE_SPELLINGS, F.regexp_replace(F.upper(F.trim(F.coalesce(_c(value), F.lit("")))), r"[\s-]+", "_"), "UNKNOWN")


def lifecycle(value: Column | str) -> Column:
    return _case(K.LIFECYCLE_SPELLINGS, F.regexp_replace(F.upper(F.trim(F.coalesce(_c(value), F.lit("")))), r"[\s-]+", "_"), "UNKNOWN")


def orbit_class(value: Column | str) -> Column:
    v = F.upper(F.trim(F.coalesce(_c(value), F.lit(""))))
    return F.when(v == "HRO", "HEO").when(v.isin(*K.ORBIT_CLASSES), v).otherwise("UNKNOWN")


def satcat_lifecycle(decay_date: Column | str, status: Column | str, ops_code: Column | str) -> Column:
    named, code = lifecycle(status), F.upper(F.trim(F.coalesce(_c(ops_code), F.lit(""))))
    return (
        F.when(F.length(F.trim(F.coalesce(_c(decay_date), F.lit("")))) > 0, "DECAYED")
        .when(named != "UNKNOWN", named)
        .when(code.isin("+", "P", "B", "S", "X"), "ACTIVE")
        .when(code.isin("-", "N"), "INACTIVE")
        .when(code == "D", "DECAYED")
        .otherwise("UNKNOWN")
    )


def norad_id(value: Column | str) -> Column:
    """Digits without leading zeros, or a letter (not I, O) with four digits; else null."""
    v = F.regexp_replace(F.upper(F.trim(_c(value).cast("string"))), r"\s+", "")
    return F.when(v.rlike(r"^\d{1,9}$"), F.regexp_replace(v, r"^0+(?=\d)", "")).when(v.rlike(r"^[A-HJ-NP-Z]\d{4}$"), v)


def designator(value: Column | str) -> Column:
    v = F.regexp_replace(F.upper(F.trim(_c(value))), r"\s+", "")
    return F.when(v.rlike(r"^\d{4}-\d{3}[A-Z]{1,3}$"), v)


def provider_token(value: Column | str) -> Column:
    v = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(value))), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.when(F.length(v) > 0, v)


def object_id(explicit: Column, norad: Column, cospar: Column, provider: Column, provider_object: Column) -> Column:
    """The first usable identity; null where an explicit one contradicts the catalog number."""
    given = F.lower(F.trim(explicit))
    by_norad = F.concat(F.lit(K.NORAD_SCHEME), F.lower(norad_id(norad)))
    clash = given.startswith(K.NORAD_SCHEME) & by_norad.isNotNull() & (given != by_norad)
    out = F.coalesce(
        F.when(F.length(given) > 0, given),
        by_norad,
        F.concat(F.lit(K.COSPAR_SCHEME), F.lower(designator(cospar))),
        F.concat(F.lit(K.PROVIDER_SCHEME), provider_token(provider), F.lit(":"), provider_token(provider_object)),
    )
    return F.when(~F.coalesce(clash, F.lit(False)), out)


def pair_key(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws("|", F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def first_present(*columns: Column | str) -> Column:
    """The first alias that isn't blank."""
    return F.coalesce(*[F.when(F.length(F.trim(_c(c).cast("string"))) > 0, _c(c)) for c in columns])


def flag_set(**flags: Column) -> Column:
    """Sorted distinct names of the flags that hold."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))))


def freshness(epoch: Column | str, klass: Column | str, reference: Column) -> dict[str, Column]:
    """age_days, max_age_days and status; stale overrides future, a missing epoch is unusable."""
    limit = F.lit(K.MAX_AGE_DAYS["UNKNOWN"])
    for name, days in K.MAX_AGE_DAYS.items():
        limit = F.when(_c(klass) == name, days).otherwise(limit)
    age = (F.unix_millis(reference.cast("timestamp")) - F.unix_millis(_c(epoch).cast("timestamp"))) / F.lit(float(K.MS_DAY))
    status = F.when(age.isNull(), "UNUSABLE").when(age > limit, "STALE").when(age < -K.FUTURE_TOLERANCE_DAYS, "FUTURE").otherwise("FRESH")
    return {"age_days": age, "max_age_days": limit, "status": status}


def event_quality(status: Column, flags: Column) -> Column:
    bad = F.exists(flags, lambda f: F.lower(f).rlike("invalid|failed|error"))
    doubtful = F.exists(flags, lambda f: F.lower(f).rlike("stale|future|epoch.after|unavailable|partial|incomplete|non.?converg|degraded|uncertain|co.?located|common.?tle"))
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when((s == "invalid") | F.coalesce(bad, F.lit(False)), "Invalid").when((s == "partial") | F.coalesce(doubtful, F.lit(False)), "Review").otherwise("Nominal")


def search_text(*columns: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.when(F.length(_c(c).cast("string")) > 0, _c(c).cast("string")) for c in columns]))


def best_rule(rules: dict[str, tuple[int, Column]]) -> Column:
    """(score, rule) of the rule that holds with the highest score; ties fall to the first named."""
    tried = [F.when(held, F.struct(F.lit(score).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("rule"))) for i, (name, (score, held)) in enumerate(rules.items())]
    return F.array_max(F.array(*tried))
