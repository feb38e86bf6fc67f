"""Every rule of a record by a row that breaks it alone; the lines are those of a published element set (fixed values)."""

import datetime

import pytest
from pyspark.sql import functions as F

from perigee.functions import constants as K
from perigee.operators import validation

ONE = "1 25544U 98067A   24001.00000000  .00016717  00000-0  10270-3 0  9005"
TWO = "2 25544  51.6400 208.9163 0006317  69.9862  25.2906 15.49560532400000"


def summed(line):
    return line[:68] + str(sum(int(c) if c.isdigit() else c == "-" for c in line[:68]) % 10)


GOOD = {"satellite_name": "STATION", "norad_id": "25544", "object_type": "PAY", "orbit_class": "LEO", "lifecycle_status": "active", "inclination_deg": "51.64", "eccentricity": "0.0006317", "tle_line1": summed(ONE), "tle_line2": summed(TWO)}
PROVENANCE = ("src", "prov", "2024-01-03T00:00:00Z", "ds", "sha256:abc", None, "COMPLETE", False, None)
P = "source_id string, provider string, retrieved_at string, dataset_id string, dataset_hash string, source_uri string, source_status string, partial_update boolean, license_id string"


def put(line, at, text):
    return summed((line[:at] + text + line[at + len(text) :])[:69])


def one(at, text, **more):
    return {"tle_line1": put(ONE, at, text), **more}


def two(at, text, **more):
    return {"tle_line2": put(TWO, at, text), **more}


E = "$.element_set"
CASES = {
    "good": ({}, []),
    "no line": ({"tle_line1": None}, [(f"{E}.line1", "TLE_LINE_REQUIRED")]),
    "short": ({"tle_line2": TWO[:50]}, [(f"{E}.line2", "TLE_LINE_LENGTH_INVALID")]),
    "number": (one(0, "7"), [(f"{E}.line1", "TLE_LINE_NUMBER_INVALID")]),
    "checksum character": ({"tle_line1": summed(ONE)[:68] + "x"}, [(f"{E}.line1[68]", "TLE_CHECKSUM_CHARACTER_INVALID")]),
    "checksum": ({"tle_line2": TWO[:68] + str((int(summed(TWO)[68]) + 1) % 10)}, [(f"{E}.line2[68]", "TLE_CHECKSUM_MISMATCH")]),
    "separator": (one(43, "x"), [(f"{E}.line1[43]", "TLE_LINE1_SEPARATOR_INVALID")]),
    "first derivative": (one(34, "0"), [(f"{E}.line1[33:43]", "TLE_MEAN_MOTION_FIRST_DERIVATIVE_INVALID")]),
    "second derivative": (one(45, "0.000"), [(f"{E}.line1[44:52]", "TLE_MEAN_MOTION_SECOND_DERIVATIVE_INVALID")]),
    "drag": (one(54, "1.027"), [(f"{E}.line1[53:61]", "TLE_BSTAR_INVALID")]),
    "type": (one(62, "x"), [(f"{E}.line1[62:63]", "TLE_EPHEMERIS_TYPE_INVALID")]),
    "type 2": (one(62, "2"), [(f"{E}.line1[62:63]", "TLE_EPHEMERIS_TYPE_UNSUPPORTED")]),
    "set number": (one(64, "9 00"), [(f"{E}.line1[64:68]", "TLE_ELEMENT_SET_NUMBER_INVALID")]),
    "catalog id": (one(2, "I5544"), [(f"{E}.line1[2:7]", "TLE_CATALOG_ID_INVALID")]),
    "ids": (two(2, "25545"), [(f"{E}.line2[2:7]", "TLE_CATALOG_ID_MISMATCH")]),
    "expected": ({"norad_id": "5"}, [(f"{E}.line1[2:7]", "TLE_EXPECTED_CATALOG_ID_MISMATCH")]),
    "expected bad": ({"norad_id": "?"}, [(f"{E}.expected_norad_id", "EXPECTED_CATALOG_ID_INVALID")]),
    "epoch": (one(20, "367"), [(f"{E}.line1[18:32]", "TLE_EPOCH_INVALID")]),
    "inclination": (two(8, "181.0000", inclination_deg=None), [(f"{E}.line2[8:16]", "NUMBER_OUT_OF_RANGE")]),
    "node": (two(17, "360.0000"), [(f"{E}.line2[17:25]", "NUMBER_OUT_OF_RANGE")]),
    "perigee": (two(34, " NaN    "), [(f"{E}.line2[34:42]", "TLE_NUMERIC_FIELD_INVALID")]),
    "anomaly": (two(43, "-1.00000"), [(f"{E}.line2[43:51]", "NUMBER_OUT_OF_RANGE")]),
    "motion": (two(52, "00.00000000"), [(f"{E}.line2[52:63]", "NUMBER_OUT_OF_RANGE")]),
    "eccentricity": (two(26, "000.631", eccentricity=None), [(f"{E}.line2[26:33]", "TLE_ECCENTRICITY_INVALID")]),
    "revolution": (two(63, "40x00"), [(f"{E}.line2[63:68]", "TLE_REVOLUTION_NUMBER_INVALID")]),
    "launch": (one(9, "98x67A"), [(f"{E}.line1[9:17]", "TLE_INTERNATIONAL_DESIGNATOR_INVALID")]),
    "name": ({"satellite_name": "  "}, [("$.name", "CATALOG_NAME_REQUIRED")]),
    "designator": ({"OBJECT_ID": "1998-067"}, [("$.international_designator", "INTERNATIONAL_DESIGNATOR_INVALID")]),
    "other designator": ({"OBJECT_ID": "1999-067A"}, [("$.international_designator", "INTERNATIONAL_DESIGNATOR_TLE_MISMATCH")]),
    "identity": ({"object_id": K.NORAD_SCHEME + "7"}, [("$.object_id", "STABLE_IDENTITY_REQUIRED")]),
    "mismatch": ({"inclination_deg": "51.65"}, [("$.inclination_deg", "DERIVED_FIELD_TLE_MISMATCH")]),
    "mismatch spelled": ({"eccentricity": "0.5"}, [("$.eccentricity", "DERIVED_FIELD_TLE_MISMATCH")]),
    "not finite": ({"apogeeKm": "NaN"}, [("$.apogeeKm", "DERIVED_FIELD_NONFINITE")]),
    "covariance": ({"covariance": "[1]"}, [("$.covariance", "COVARIANCE_OBJECT_OR_NULL_REQUIRED")]),
    "radius": ({"hard_body_radius_km": "-0.1"}, [("$.hard_body_radius_km", "NUMBER_OUT_OF_RANGE")]),
    "radius text": ({"hardBodyRadiusKm": "big"}, [("$.hard_body_radius_km", "FINITE_NUMBER_REQUIRED")]),
    "future": (one(20, "020"), [("$.element_set.epoch", "TLE_EPOCH_IN_FUTURE")]),
}
WARNINGS = {
    "type unknown": ({"object_type": None}, [("$.object_type", "OBJECT_TYPE_UNKNOWN")]),
    "class unknown": ({"orbit_class": "?"}, [("$.orbit_class", "ORBIT_CLASS_UNKNOWN")]),
    "lifecycle unknown": ({"lifecycle_status": None}, [("$.lifecycle_status", "LIFECYCLE_STATUS_UNKNOWN")]),
    "stale": ({"tle_line1": put(ONE, 18, "23001.00000000")}, [("$.element_set.epoch", "TLE_STALE")]),
}


def frame(spark, cases, provenance=PROVENANCE):
    rows = [(k, {a: b for a, b in {**GOOD, **change}.items() if b is not None}) for k, (change, _) in cases.items()]
    return spark.createDataFrame([(k, r, provenance) for k, r in rows], f"k string, record map<string,string>, p struct<{P.replace(' string', ':string').replace(' boolean', ':boolean')}>")


def judged(table, **kw):
    return {r.k: r for r in validation.validated(table.withColumn("issues", F.lit("clash")), F.col("p"), **kw).collect()}


def test_each_rule(spark):
    got = judged(frame(spark, CASES))
    for k, (_, want) in CASES.items():
        assert [(x.path, x.code) for x in got[k].issues] == want and got[k].accepted == (not want) and (got[k].object is None) == bool(want), k
        assert all(x.severity == "error" for x in got[k].issues)


def test_warnings_are_accepted_unless_the_policy_says_so(spark):
    got = judged(frame(spark, WARNINGS))
    for k, (_, want) in WARNINGS.items():
        assert [(x.path, x.code, x.severity) for x in got[k].issues] == [(*w, "warning") for w in want] and got[k].accepted and want[0][1] in got[k].object.quality_flags
    strict = judged(frame(spark, WARNINGS), policy=validation.Policy(require_known_type=True, stale_is_error=True))
    assert {k: r.accepted for k, r in strict.items()} == {"type unknown": False, "class unknown": True, "lifecycle unknown": True, "stale": False}
    assert strict["type unknown"].issues[0].code == "OBJECT_TYPE_REQUIRED"
    later = judged(frame(spark, {"good": ({}, [])}), reference=F.lit("2024-03-01").cast("timestamp"))["good"]
    assert [x.code for x in later.issues] == ["TLE_STALE"] and later.object.age_days == pytest.approx(60)


def test_the_object(spark):
    r = judged(frame(spark, {"good": ({"type": "x", "OBJECT_ID": "1998-067a", "covariance": "{}", "hardBodyRadiusKm": "0.01"}, []), "typed": ({"orbit_class": None, "type": "LEO"}, [])}))
    o = r["good"].object
    assert (o.object_id, o.name, o.norad_id, o.international_designator, o.object_type, o.orbit_class, o.lifecycle_status) == (K.NORAD_SCHEME + "25544", "STATION", "25544", "1998-067A", "PAYLOAD", "LEO", "ACTIVE")
    assert o.epoch == datetime.datetime(2024, 1, 1) and o.age_days == 2 and o.hard_body_radius_km == 0.01 and o.quality_flags == ["COVARIANCE_UNVALIDATED"] and o.element_set_id.startswith("elset:tle:")
    assert r["typed"].object.orbit_class == "LEO" and r["typed"].object.quality_flags == ["LEGACY_TYPE_USED_AS_ORBIT_CLASS"]


def test_provenance(spark):
    bad = {
        0: (" ", "source_id", "TYPE_NONEMPTY_STRING_REQUIRED"), 1: (None, "provider", "TYPE_NONEMPTY_STRING_REQUIRED"), 2: ("soon", "retrieved_at", "UTC_TIMESTAMP_INVALID"), 4: ("abc", "dataset_hash", "HASH_FORMAT_INVALID"),
        5: ("", "source_uri", "TYPE_NONEMPTY_STRING_REQUIRED"), 6: ("GONE", "source_status", "ENUM_VALUE_REQUIRED"), 7: (None, "partial_update", "TYPE_BOOLEAN_REQUIRED"),
    }
    tables = [frame(spark, {f"{i}": ({}, [])}, PROVENANCE[:i] + (v,) + PROVENANCE[i + 1 :]) for i, (v, _, _) in bad.items()]
    tables += [frame(spark, {"partial": ({}, [])}, PROVENANCE[:6] + ("PARTIAL", False, None)), frame(spark, {"none": ({}, [])}, None)]
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    got = judged(whole.unionByName(spark.createDataFrame([("null", None, PROVENANCE)], whole.schema)).unionByName(tables[0]))
    for i, (_, path, code) in bad.items():
        assert [(x.path, x.code) for x in got[str(i)].issues] == [(f"$.provenance.{path}", code)] and not got[str(i)].accepted
    assert [x.code for x in got["partial"].issues] == ["PARTIAL_STATUS_MISMATCH"] and [x.code for x in got["none"].issues] == ["TYPE_OBJECT_REQUIRED"]
    assert [(x.path, x.code) for x in got["null"].issues] == [("$", "CATALOG_RECORD_REQUIRED")]
    assert validation.validated(whole.limit(0), F.col("p")).count() == 0
