"""Validation of catalog records: one list of issues (path, code, severity) for each, and the record as it is used when none is an error.

Records are maps of text, as JSON gives them, so that spellings of a field can be looked up in
order.  All rules are columns; a record is judged in one pass and never shuffled.  Rules of the
record itself are tested once its provenance and element set hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.functions import catalog as C
from perigee.functions import constants as K
from perigee.functions import identity as I

ISSUE = "struct<path:string,code:string,severity:string>"

# Spellings of a record's fields, in the order in which they are tried.
FIELDS = {
    "name": ("name", "satellite_name", "object_name", "OBJECT_NAME"),
    "line1": ("tle_line1", "tleLine1", "TLE_LINE1", "line1"),
    "line2": ("tle_line2", "tleLine2", "TLE_LINE2", "line2"),
    "norad_id": ("norad_id", "noradId", "NORAD_CAT_ID"),
    "internal_object_id": ("internal_object_id", "internalObjectId"),
    "object_id": ("object_id", "objectId"),
    "international_designator": ("international_designator", "internationalDesignator", "OBJECT_ID"),
    "provider_object_id": ("provider_object_id", "providerObjectId", "source_record_id"),
    "object_type": ("object_type", "objectType", "OBJECT_TYPE"),
    "orbit_class": ("orbit_class", "orbitClass", "ORBIT_CLASS"),
    "lifecycle_status": ("lifecycle_status", "lifecycleStatus", "operational_status", "operationalStatus"),
    "inclination_deg": ("inclination_deg", "inclinationDeg"),
    "eccentricity": ("eccentricity",),
    "mean_motion_rev_per_day": ("mean_motion_rev_per_day", "meanMotionRevPerDay"),
    "period_min": ("period_min", "periodMin"),
    "semi_major_axis_km": ("semi_major_axis_km", "semiMajorAxisKm"),
    "perigee_km": ("perigee_km", "perigeeKm"),
    "apogee_km": ("apogee_km", "apogeeKm"),
    "estimated_altitude_km": ("estimated_altitude_km", "estimatedAltitudeKm"),
    "hard_body_radius_km": ("hard_body_radius_km", "hardBodyRadiusKm"),
}
# States of a source, columns (from 0) of line 1 that are blank, and tolerances of fields that repeat the lines'.
SOURCE_STATES = ("COMPLETE", "PARTIAL", "DEGRADED")
BLANKS = (8, 17, 32, 43, 52, 61, 63)
TOLERANCES = {"inclination_deg": 5e-4, "eccentricity": 5e-8, "mean_motion_rev_per_day": 5e-8}


@dataclass(frozen=True)
class Policy:
    require_known_type: bool = False
    stale_is_error: bool = False


def issue(when: Column, path: str | Column, code: str, severity: str = "error") -> Column:
    """An issue where the rule is broken (or can't be told), else null."""
    there = path if isinstance(path, Column) else F.lit(path)
    return F.when(F.coalesce(when, F.lit(True)), F.struct(there.alias("path"), F.lit(code).alias("code"), F.lit(severity).alias("severity")).cast(ISSUE))


def _listed(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues))


def _under(issues: Column, prefix: str) -> Column:
    return F.transform(issues, lambda x: F.struct(F.concat(F.lit(prefix), F.substring(x["path"], 2, 1 << 20)).alias("path"), x["code"].alias("code"), x["severity"].alias("severity")))


def _none() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def said(record: Column, field: str) -> Column:
    """The first spelling of a field that the record has a value for."""
    return F.coalesce(*[F.try_element_at(record, F.lit(k)) for k in FIELDS[field]])


def _spelling(record: Column, field: str) -> Column:
    names = FIELDS[field]
    found = F.lit(f"$.{names[0]}")
    for k in reversed(names):
        found = F.when(F.try_element_at(record, F.lit(k)).isNotNull(), f"$.{k}").otherwise(found)
    return found


def _number(text: Column) -> Column:
    """A finite number of a text, or null."""
    v = F.trim(text).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def provenance_issues(p: Column) -> Column:
    """Of a struct source_id, provider, retrieved_at, dataset_id, dataset_hash, source_uri, source_status, partial_update, license_id."""
    blank = lambda c: c.isNull() | (F.length(F.trim(c)) == 0)
    kind = "TYPE_NONEMPTY_STRING_REQUIRED"
    digest = p["dataset_hash"]
    return F.when(p.isNull(), _listed(issue(F.lit(True), "$", "TYPE_OBJECT_REQUIRED"))).otherwise(_listed(
        *[issue(blank(p[c]), f"$.{c}", kind) for c in ("source_id", "provider", "dataset_id", "dataset_hash")],
        issue(~blank(digest) & ~digest.rlike(r"^[a-z0-9][a-z0-9_-]*:[A-Za-z0-9+/_=-]+$"), "$.dataset_hash", "HASH_FORMAT_INVALID"),
        issue(p["retrieved_at"].isNotNull() & p["retrieved_at"].try_cast("timestamp").isNull(), "$.retrieved_at", "UTC_TIMESTAMP_INVALID"),
        *[issue(p[c].isNotNull() & blank(p[c]), f"$.{c}", kind) for c in ("source_uri", "license_id")],
        issue(~F.coalesce(p["source_status"].isin(*SOURCE_STATES), F.lit(False)), "$.source_status", "ENUM_VALUE_REQUIRED"),
        issue(p["partial_update"].isNull(), "$.partial_update", "TYPE_BOOLEAN_REQUIRED"),
        issue((p["source_status"] == "PARTIAL") & ~F.coalesce(p["partial_update"], F.lit(False)), "$.partial_update", "PARTIAL_STATUS_MISMATCH"),
    ))


def element_issues(one: Column, two: Column, expected_norad: Column) -> Column:
    """Every strict rule that a two-line set breaks; lines of a wrong length are judged no further."""
    cut = lambda c, a, b: F.substring(c, a + 1, b - a)
    shape, checks = [], []
    for n, c in ((1, one), (2, two)):
        whole = F.length(c) == 69
        shape += [issue(c.isNull(), f"$.line{n}", "TLE_LINE_REQUIRED"), issue(c.isNotNull() & (F.length(c) != 69), f"$.line{n}", "TLE_LINE_LENGTH_INVALID")]
        digit = cut(c, 68, 69).rlike("^[0-9]$")
        shape += [
            issue(F.coalesce(whole, F.lit(False)) & ~c.startswith(f"{n} "), f"$.line{n}", "TLE_LINE_NUMBER_INVALID"),
            issue(F.coalesce(whole, F.lit(False)) & ~digit, f"$.line{n}[68]", "TLE_CHECKSUM_CHARACTER_INVALID"),
            issue(F.coalesce(whole & digit & (C.tle_checksum(c) != cut(c, 68, 69).try_cast("int")), F.lit(False)), f"$.line{n}[68]", "TLE_CHECKSUM_MISMATCH"),
        ]
    checks += [issue(cut(one, i, i + 1) != " ", f"$.line1[{i}]", "TLE_LINE1_SEPARATOR_INVALID") for i in BLANKS]
    form = lambda a, b, pattern, code, line=1: issue(~cut(one if line == 1 else two, a, b).rlike(pattern), f"$.line{line}[{a}:{b}]", code)
    checks += [
        form(33, 43, r"^[ +\-]\.[0-9]{8}$", "TLE_MEAN_MOTION_FIRST_DERIVATIVE_INVALID"),
        form(44, 52, r"^[ +\-][0-9]{5}[+\-][0-9]$", "TLE_MEAN_MOTION_SECOND_DERIVATIVE_INVALID"),
        form(53, 61, r"^[ +\-][0-9]{5}[+\-][0-9]$", "TLE_BSTAR_INVALID"),
        form(62, 63, "^[0-9]$", "TLE_EPHEMERIS_TYPE_INVALID"),
        issue(cut(one, 62, 63).rlike("^[1-9]$"), "$.line1[62:63]", "TLE_EPHEMERIS_TYPE_UNSUPPORTED"),
        form(64, 68, "^ *[0-9]+$", "TLE_ELEMENT_SET_NUMBER_INVALID"),
    ]
    ids = [C.norad_id(cut(c, 2, 7)) for c in (one, two)]
    no = F.lit(False)
    checks += [issue(i.isNull(), f"$.line{n}[2:7]", "TLE_CATALOG_ID_INVALID") for n, i in enumerate(ids, 1)]
    checks.append(issue(F.coalesce(ids[0] != ids[1], no), "$.line2[2:7]", "TLE_CATALOG_ID_MISMATCH"))
    told = expected_norad.isNotNull()
    checks += [
        issue(F.coalesce(told & (ids[0] != C.norad_id(expected_norad)), no), "$.line1[2:7]", "TLE_EXPECTED_CATALOG_ID_MISMATCH"),
        issue(told & C.norad_id(expected_norad).isNull(), "$.expected_norad_id", "EXPECTED_CATALOG_ID_INVALID"),
        issue(C.strict_epoch(cut(one, 18, 32)).isNull(), "$.line1[18:32]", "TLE_EPOCH_INVALID"),
    ]
    for a, b, low, high, closed in ((8, 16, 0.0, 180.0, True), (17, 25, 0.0, 360.0, False), (34, 42, 0.0, 360.0, False), (43, 51, 0.0, 360.0, False), (52, 63, 5e-324, None, True)):
        v = _number(cut(two, a, b))
        out = v < low
        if high is not None:
            out = out | ((v > high) if closed else (v >= high))
        checks += [issue(v.isNull(), f"$.line2[{a}:{b}]", "TLE_NUMERIC_FIELD_INVALID"), issue(F.coalesce(out, no), f"$.line2[{a}:{b}]", "NUMBER_OUT_OF_RANGE")]
    checks += [form(26, 33, "^[0-9]{7}$", "TLE_ECCENTRICITY_INVALID", 2), issue(~F.trim(cut(two, 63, 68)).rlike("^[0-9]+$"), "$.line2[63:68]", "TLE_REVOLUTION_NUMBER_INVALID")]
    launch = F.trim(cut(one, 9, 17))
    checks.append(issue((F.length(launch) > 0) & line_designator(one).isNull(), "$.line1[9:17]", "TLE_INTERNATIONAL_DESIGNATOR_INVALID"))
    shaped = F.coalesce((F.length(one) == 69) & (F.length(two) == 69), no)
    return F.concat(_listed(*shape), F.when(shaped, _listed(*checks)).otherwise(_none()))


def line_designator(one: Column) -> Column:
    """The launch designator of line 1 with a year of four digits, or null."""
    token = F.trim(F.substring(one, 10, 8))
    year = F.substring(token, 1, 2).try_cast("int")
    return F.when(token.rlike(r"^[0-9]{5}[A-Za-z]{1,3}$"), C.designator(F.concat((F.when(year >= 57, 1900).otherwise(2000) + year).cast("string"), F.lit("-"), F.substring(token, 3, 8))))


def validated(records: DataFrame, provenance: Column, reference: Column | None = None, policy: Policy = Policy(), record: str = "record") -> DataFrame:
    """``records`` with ``issues``, ``accepted`` and ``object``, the record as it is used (null unless accepted).

    ``record`` is a map of text; ``provenance`` a struct (:func:`provenance_issues`); ages count
    from ``reference`` or from the time of retrieval.  A null map is an issue of its own; rows
    that repeat are judged alike; an empty table gives none; other columns are passed on.
    """
    r = F.col(record)
    base = records.drop("issues", "accepted", "object").withColumn("__p", provenance)
    base = base.withColumns({f"__{k}": said(r, k) for k in FIELDS})
    f = {k: F.col(f"__{k}") for k in FIELDS}
    one, two, p = f["line1"], f["line2"], F.col("__p")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    base = base.withColumns({"__source": _under(provenance_issues(p), "$.provenance"), "__elements": _under(element_issues(one, two, f["norad_id"]), "$.element_set")})
    held = (F.size("__source") == 0) & (F.size("__elements") == 0)

    scheme = F.lower(text(f["object_id"])).startswith(K.ID_SCHEME)
    explicit = F.coalesce(F.when(F.length(text(f["internal_object_id"])) > 0, text(f["internal_object_id"])), F.when(scheme, text(f["object_id"])))
    by_line = line_designator(one)
    given = F.coalesce(f["international_designator"], F.when(text(f["object_id"]).rlike(r"^\d{4}-\d{3}[A-Za-z0-9]{0,3}$"), text(f["object_id"])))
    norad = F.coalesce(f["norad_id"], C.norad_id(F.substring(one, 3, 5)))
    ident = C.object_id(explicit, norad, C.designator(F.coalesce(given, by_line)), p["source_id"], f["provider_object_id"])
    known = {"object_type": C.object_type(f["object_type"]), "orbit_class": C.orbit_class(F.coalesce(f["orbit_class"], F.try_element_at(r, F.lit("type")))), "lifecycle_status": C.lifecycle(f["lifecycle_status"])}
    base = base.withColumns({"__id": ident, "__designator": F.coalesce(given, by_line), "__epoch": C.strict_epoch(F.substring(one, 19, 14)), **{f"__is_{k}": v for k, v in known.items()}})
    at = reference if reference is not None else p["retrieved_at"].try_cast("timestamp")
    fresh = C.freshness("__epoch", "__is_orbit_class", at)
    base = base.withColumns({"__fresh": fresh["status"], "__age_days": fresh["age_days"]})
    unknown = lambda c: F.col(f"__is_{c}") == "UNKNOWN"
    no = F.lit(False)
    of_lines = {"inclination_deg": _number(F.substring(two, 9, 8)), "eccentricity": F.concat(F.lit("0."), F.substring(two, 27, 7)).try_cast("double"), "mean_motion_rev_per_day": _number(F.substring(two, 53, 11))}
    derived = []
    for k in (*TOLERANCES, "period_min", "semi_major_axis_km", "perigee_km", "apogee_km", "estimated_altitude_km"):
        derived.append(issue(f[k].isNotNull() & _number(f[k]).isNull(), _spelling(r, k), "DERIVED_FIELD_NONFINITE"))
        if k in TOLERANCES:
            derived.append(issue(F.coalesce(F.abs(_number(f[k]) - of_lines[k]) > TOLERANCES[k], no), _spelling(r, k), "DERIVED_FIELD_TLE_MISMATCH"))
    covariance = F.try_element_at(r, F.lit("covariance"))
    radius = f["hard_body_radius_km"]
    wrong = F.col("__designator").isNotNull() & by_line.isNotNull()
    rules = _listed(
        issue(F.length(text(f["name"])) == 0, "$.name", "CATALOG_NAME_REQUIRED"),
        issue(wrong & C.designator("__designator").isNull(), "$.international_designator", "INTERNATIONAL_DESIGNATOR_INVALID"),
        issue(F.coalesce(wrong & (C.designator("__designator") != by_line), no), "$.international_designator", "INTERNATIONAL_DESIGNATOR_TLE_MISMATCH"),
        issue(F.col("__id").isNull(), "$.object_id", "STABLE_IDENTITY_REQUIRED"),
    )
    later = _listed(
        issue(unknown("object_type"), "$.object_type", "OBJECT_TYPE_REQUIRED") if policy.require_known_type else issue(unknown("object_type"), "$.object_type", "OBJECT_TYPE_UNKNOWN", "warning"),
        issue(unknown("orbit_class"), "$.orbit_class", "ORBIT_CLASS_UNKNOWN", "warning"),
        issue(unknown("lifecycle_status"), "$.lifecycle_status", "LIFECYCLE_STATUS_UNKNOWN", "warning"),
        *derived,
        issue(covariance.isNotNull() & ~covariance.rlike(r"(?s)^\s*\{.*\}\s*$"), "$.covariance", "COVARIANCE_OBJECT_OR_NULL_REQUIRED"),
        issue(radius.isNotNull() & _number(radius).isNull(), "$.hard_body_radius_km", "FINITE_NUMBER_REQUIRED"),
        issue(F.coalesce(_number(radius) < 0, no), "$.hard_body_radius_km", "NUMBER_OUT_OF_RANGE"),
        issue(F.coalesce(F.col("__fresh") == "FUTURE", no), "$.element_set.epoch", "TLE_EPOCH_IN_FUTURE"),
        issue(F.coalesce(F.col("__fresh") == "STALE", no), "$.element_set.epoch", "TLE_STALE", "error" if policy.stale_is_error else "warning"),
    )
    own = F.concat(rules, F.when(F.col("__id").isNotNull(), later).otherwise(_none()))
    issues = F.when(r.isNull(), _listed(issue(F.lit(True), "$", "CATALOG_RECORD_REQUIRED"))).otherwise(F.concat("__source", "__elements", F.when(held, own).otherwise(_none())))
    legacy = f["orbit_class"].isNull() & F.try_element_at(r, F.lit("type")).isNotNull()
    flags = C.flag_set(
        OBJECT_TYPE_UNKNOWN=unknown("object_type"), ORBIT_CLASS_UNKNOWN=unknown("orbit_class"), LIFECYCLE_STATUS_UNKNOWN=unknown("lifecycle_status"),
        LEGACY_TYPE_USED_AS_ORBIT_CLASS=legacy, COVARIANCE_UNVALIDATED=covariance.isNotNull(), TLE_EPOCH_IN_FUTURE=F.col("__fresh") == "FUTURE", TLE_STALE=F.col("__fresh") == "STALE",
    )
    used = F.struct(
        F.col("__id").alias("object_id"), text(f["name"]).alias("name"), C.norad_id(F.substring(one, 3, 5)).alias("norad_id"), C.designator("__designator").alias("international_designator"),
        *[F.col(f"__is_{k}").alias(k) for k in known], I.identity_evidence(F.col("__id"), norad, F.col("__designator"), f["provider_object_id"], p["source_id"]).alias("identity"),
        I.element_set_id(F.col("__id"), "TLE", one, two).alias("element_set_id"), F.col("__epoch").alias("epoch"), one.alias("line1"), two.alias("line2"), covariance.alias("covariance"),
        _number(radius).alias("hard_body_radius_km"), F.col("__age_days").alias("age_days"), flags.alias("quality_flags"),
    )
    out = base.withColumn("issues", issues).withColumn("accepted", ~F.exists("issues", lambda x: x["severity"] == "error"))
    return out.withColumn("object", F.when(F.col("accepted"), used)).drop(*[c for c in base.columns if c.startswith("__")])
