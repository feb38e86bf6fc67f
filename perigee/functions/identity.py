"""Identities, fingerprints and the fields of event rows under their several names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perigee.functions import catalog as C
from perigee.functions import constants as K
from perigee.functions.hashing import fnv1a64


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _said(x: Column | str) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def element_set_id(object_id: Column, form: str, line1: Column | None = None, line2: Column | None = None, source_record: Column | None = None) -> Column:
    """``elset:format:object:fingerprint`` of the object, the format, both lines and the source's record."""
    name = form.lower()
    parts = [object_id, F.lit(name), *(_said(x) if x is not None else F.lit("") for x in (line1, line2, source_record))]
    return F.when(object_id.isNotNull(), F.concat(F.lit(f"elset:{name}:"), object_id, F.lit(":"), fnv1a64(F.concat_ws("\n", *parts))))


def event_id(a: Column | str, b: Column | str, tca: Column | str, request: Column | str | None = None) -> Column:
    """``conjunction:fingerprint`` of the ordered pair, the time and the request; null for a pair of one."""
    asked = _said(request) if request is not None else F.lit("")
    return F.when(_c(a) != _c(b), F.concat(F.lit("conjunction:"), fnv1a64(F.concat_ws("\n", C.pair_key(a, b), _c(tca), asked))))


def record_fingerprint(*fields: Column | str) -> Column:
    """FNV of the fields joined by newlines, null being empty."""
    return F.concat(F.lit("fnv1a64:"), fnv1a64(F.concat_ws("\n", *map(_said, fields))))


def identity_evidence(object_id: Column, norad: Column, cospar: Column, provider_object: Column, source: Column) -> Column:
    """A struct of object_id, scheme, provisional and the evidence (kind, value, source_id) that a record has."""
    given = lambda kind, value: F.when(value.isNotNull() & (F.length(value) > 0), F.struct(F.lit(kind).alias("kind"), value.alias("value"), source.alias("source_id")))
    found = F.array_compact(F.array(given("NORAD_CATALOG_ID", C.norad_id(norad)), given("INTERNATIONAL_DESIGNATOR", C.designator(cospar)), given("PROVIDER_OBJECT_ID", F.trim(provider_object))))
    scheme = F.when(object_id.startswith(K.NORAD_SCHEME), "NORAD").when(object_id.startswith(K.COSPAR_SCHEME), "COSPAR").otherwise("PROVIDER")
    return F.struct(object_id.alias("object_id"), scheme.alias("scheme"), (scheme == "PROVIDER").alias("provisional"), found.alias("evidence"))


def registry_status(status: Column, mode: Column, partial: Column) -> Column:
    """A source's status in the registry: anything but ok is degraded, an incremental or partial one partial, a full one complete."""
    ok, said = F.lower(F.trim(_said(status))) == "ok", F.lower(F.trim(_said(mode)))
    return F.when(~ok, "DEGRADED").when((said == "incremental") | F.coalesce(partial, F.lit(False)), "PARTIAL").when(said == "all", "COMPLETE").otherwise("DEGRADED")


def viewer_status(status: Column, mode: Column, rejected: Column, fetched: Column, total: Column) -> Column:
    """A source's status for the viewer, from its counts."""
    said = F.lower(F.trim(_said(status)))
    some = (F.lower(F.trim(_said(mode))) == "incremental") | F.coalesce(fetched < total, F.lit(False))
    return F.when((said == "ok") & (F.coalesce(rejected, F.lit(0)) == 0) & ~some, "COMPLETE").when(said.isin("ok", "partial"), "PARTIAL").otherwise("DEGRADED")


def model_key(value: Column | str) -> Column:
    """Lower case without a file's extension and anything but letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_said(value))), r"\.[a-z0-9]+$", ""), r"[^a-z0-9]+", "")


def constellation_number(name: Column | str, family: str = "STARLINK", most: int = 5) -> Column:
    """The number of four to ``most`` digits that follows the family's name."""
    digits = F.regexp_extract(F.upper(_said(name)), rf"\b{family}[-\s]?(\d{{4,{most}}})\b", 1)
    return F.when(F.length(digits) > 0, digits.cast("int"))


def is_second_generation(texts: list[Column], generation: list[Column], name: Column, most: int = 5) -> Column:
    """Whether a satellite of the family says so of its version, or has a number from 30000 on."""
    family = F.lower(F.concat_ws(" ", *map(_said, texts))).rlike("starlink|spacex")
    said = F.concat_ws(" ", *[model_key(x) for x in generation])
    stated = said.contains("starlinkv2") | said.contains("v2mini") | F.array_contains(F.split(said, r"\s+"), "v2")
    return family & (stated | F.coalesce(constellation_number(name, most=most) >= 30000, F.lit(False)))


# Points of the seven ways in which a model can match a satellite, best first.
MATCH_POINTS = {"restricted_name": 115, "satellite_id": 110, "second_generation": 105, "catalog_number": 100, "first_generation": 90, "exact_field": 80, "alias": 50}


def model_match(held: dict[str, Column], restricted: Column) -> Column:
    """(score, order, rule) of the best way that holds, null if none does.

    A model that is ``restricted`` to names or ids matches by one of these or not at all.
    """
    barred = restricted & ~held["restricted_name"] & ~held["satellite_id"]
    return F.when(~barred, C.best_rule({name: (points, held[name]) for name, points in MATCH_POINTS.items()}))


def nominal_altitude_m(altitude: Column, slot: Column) -> Column:
    """The altitude, else what the orbital slot says before km, else a geostationary one."""
    said = F.regexp_extract(_said(slot), r"(?i)([\d.]+)\s*km", 1).try_cast("double") * 1000.0
    return F.coalesce(F.when(altitude != 0, altitude.cast("double")), said, F.lit(35_786_000.0))


# Metres of units of length.
UNIT_METRES = {"m": 1.0, "meter": 1.0, "meters": 1.0, "cm": 0.01, "centimeter": 0.01, "centimeters": 0.01, "mm": 0.001, "millimeter": 0.001, "millimeters": 0.001, "km": 1000.0, "kilometer": 1000.0, "kilometers": 1000.0}


def unit_metres(unit: Column | str, fallback: float = 1.0) -> Column:
    """Metres of a unit's name or of a positive number; else the fallback."""
    said = F.lower(F.trim(_said(unit)))
    named = F.try_element_at(F.create_map(*[F.lit(x) for k, v in UNIT_METRES.items() for x in (k, v)]), said)
    number = said.try_cast("double")
    return F.coalesce(named, F.when((number > 0) & ~F.isnan(number) & (number < float("inf")), number), F.lit(fallback))


# event rows -------------------------------------------------------------------

# The names under which event rows hold a field, best first.
EVENT_FIELDS = {
    "event_id": ("event_revision_id", "event_id", "conjunction_id"),
    "request_id": ("job_id", "request_id"),
    "primary_object_id": ("object_a_id", "primary_object_id"),
    "secondary_object_id": ("object_b_id", "secondary_object_id"),
    "tca": ("tca_utc", "tca"),
    "relative_speed_km_s": ("relative_speed_km_s", "relative_velocity_km_s"),
    "miss_distance_km": ("missDistanceKm", "miss_distance_km"),
}


def event_fields(row: Column | str, payload: Column | str | None = None) -> dict[str, Column]:
    """The fields of :data:`EVENT_FIELDS` from a map of texts; what the payload, a map too, says comes second."""
    both = _c(row) if payload is None else F.map_zip_with(_c(row), F.coalesce(_c(payload), F.create_map().cast("map<string,string>")), lambda _, a, b: F.coalesce(a, b))
    out = {name: F.coalesce(*[F.nullif(F.try_element_at(both, F.lit(n)), F.lit("")) for n in names]) for name, names in EVENT_FIELDS.items()}
    return out | {n: out[n].try_cast("double") for n in ("relative_speed_km_s", "miss_distance_km")}


def secondary_label(name: Column, ident: Column) -> Column:
    """Name and id of an event's other object; a catalog id reads NORAD and its number."""
    said = _said(ident)
    short = F.when(said.rlike(r"(?i)^([a-z]+:)?norad:"), F.concat(F.lit("NORAD "), F.substring_index(said, ":", -1))).otherwise(said)
    both = (F.length(_said(name)) > 0) & (F.length(short) > 0) & ~F.contains(_said(name), short)
    return F.when(both, F.concat(name, F.lit(" ("), short, F.lit(")"))).otherwise(F.coalesce(F.nullif(_said(name), F.lit("")), F.nullif(short, F.lit("")), F.lit("Unknown object")))
