"""Queries over validated records, with the SQL that must agree: every part is a record in which one rule is broken."""

from __future__ import annotations

from pyspark.sql import functions as F

from perigee.functions import catalog as C
from perigee.operators import catalog as OC
from perigee.operators import validation
from perigee.plans.queries import dealt, query, read

# The lines of a published element set, without their checksums.
_ONE = "1 25544U 98067A   24001.00000000  .00016717  00000-0  10270-3 0  900"
_TWO = "2 25544  51.6400 208.9163 0006317  69.9862  25.2906 15.4956053240000"

#: Line, column from 0 and text put there, and the codes that follow.
LINES = [
    (1, 0, "1", ""), (1, 0, "7", "TLE_LINE_NUMBER_INVALID"), (2, 1, "x", "TLE_LINE_NUMBER_INVALID"), (1, 8, "x", "TLE_LINE1_SEPARATOR_INVALID"), (1, 63, "x", "TLE_LINE1_SEPARATOR_INVALID"),
    (1, 34, "0", "TLE_MEAN_MOTION_FIRST_DERIVATIVE_INVALID"), (1, 45, "0.000", "TLE_MEAN_MOTION_SECOND_DERIVATIVE_INVALID"), (1, 54, "1.027", "TLE_BSTAR_INVALID"),
    (1, 62, "x", "TLE_EPHEMERIS_TYPE_INVALID"), (1, 62, "3", "TLE_EPHEMERIS_TYPE_UNSUPPORTED"), (1, 64, "9 00", "TLE_ELEMENT_SET_NUMBER_INVALID"), (1, 2, "I5544", "TLE_CATALOG_ID_INVALID"),
    (2, 2, "25545", "TLE_CATALOG_ID_MISMATCH"), (1, 20, "367", "TLE_EPOCH_INVALID"), (2, 8, "181.0000", "NUMBER_OUT_OF_RANGE"), (2, 17, "360.0000", "NUMBER_OUT_OF_RANGE"), (2, 26, "00.6317", "TLE_ECCENTRICITY_INVALID"),
    (2, 34, "     NaN", "TLE_NUMERIC_FIELD_INVALID"), (2, 43, "-1.00000", "NUMBER_OUT_OF_RANGE"), (2, 52, "00.00000000", "NUMBER_OUT_OF_RANGE"), (2, 63, "40x00", "TLE_REVOLUTION_NUMBER_INVALID"), (1, 9, "98x67A", "TLE_INTERNATIONAL_DESIGNATOR_INVALID"),
]


def _lines(k, cases):
    """Both lines with what the case of ``k`` puts in, and their checksums."""
    out = []
    for n, line in ((1, _ONE), (2, _TWO)):
        text = F.lit(line)
        for i, (m, at, put, _) in enumerate(cases):
            if m == n:
                text = F.when(k % len(cases) == i, (line[:at] + put + line[at + len(put) :])[:68]).otherwise(text)
        out.append(F.concat(text, C.tle_checksum(text).cast("string")))
    return out


@query("SELECT p_partkey, CASE p_partkey % " + str(len(LINES)) + " " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, _, _, c) in enumerate(LINES)) + " END AS codes FROM part")
def element_rules(spark, sf):
    """Each rule of a two-line set, broken alone in every so many parts."""
    k = F.col("p_partkey")
    one, two = _lines(k, LINES)
    rows = dealt(read(spark, sf, "part", "p_partkey"), "p_partkey").select(k, one.alias("one"), two.alias("two"))
    found = validation.element_issues(F.col("one"), F.col("two"), F.lit(None).cast("string"))
    return rows.select("p_partkey", F.array_join(F.array_sort(F.transform(found, lambda x: x["code"])), ",").alias("codes"))


#: Field, its value in the record, the codes that follow, and whether the record is still accepted.
RECORDS = [
    ("note", "x", "", True), ("satellite_name", " ", "$.name CATALOG_NAME_REQUIRED", False), ("object_type", "?", "$.object_type OBJECT_TYPE_UNKNOWN", True), ("orbit_class", "?", "$.orbit_class ORBIT_CLASS_UNKNOWN", True),
    ("lifecycle_status", "?", "$.lifecycle_status LIFECYCLE_STATUS_UNKNOWN", True), ("inclinationDeg", "51.7", "$.inclinationDeg DERIVED_FIELD_TLE_MISMATCH", False), ("apogee_km", "high", "$.apogee_km DERIVED_FIELD_NONFINITE", False),
    ("covariance", "[]", "$.covariance COVARIANCE_OBJECT_OR_NULL_REQUIRED", False), ("covariance", "{}", "", True), ("hard_body_radius_km", "-1", "$.hard_body_radius_km NUMBER_OUT_OF_RANGE", False),
    ("OBJECT_ID", "1999-067A", "$.international_designator INTERNATIONAL_DESIGNATOR_TLE_MISMATCH", False), ("norad_id", "5", "$.element_set.line1[2:7] TLE_EXPECTED_CATALOG_ID_MISMATCH", False),
    ("tle_line1", "short", "$.element_set.line1 TLE_LINE_LENGTH_INVALID", False),
]
_WHICH = f"CASE p_partkey % {len(RECORDS)} "


@query(
    "SELECT p_partkey, " + _WHICH + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, _, c, _) in enumerate(RECORDS)) + " END AS issues, " + _WHICH + " ".join(f"WHEN {i} THEN {str(ok).lower()}" for i, (_, _, _, ok) in enumerate(RECORDS)) + " END AS accepted, "
    + _WHICH + " ".join(f"WHEN {i} THEN {'NULL' if not ok else chr(39) + '25544' + chr(39)}" for i, (_, _, _, ok) in enumerate(RECORDS)) + " END AS norad_id FROM part"
)
def record_issues(spark, sf):
    """Whole records: what is said of each, whether it is accepted, and the number that the accepted ones are used with."""
    k = F.col("p_partkey")
    one, two = _lines(k, [(1, 0, "1", "")])
    good = {"satellite_name": F.lit("STATION"), "object_type": F.lit("PAY"), "orbit_class": F.lit("LEO"), "lifecycle_status": F.lit("ACTIVE"), "tle_line1": one, "tle_line2": two}
    plain = F.create_map(*[x for n, c in good.items() for x in (F.lit(n), c)])
    put = F.lit(None).cast("map<string,string>")
    for i, (field, value, _, _) in enumerate(RECORDS):
        put = F.when(k % len(RECORDS) == i, F.create_map(F.lit(field), F.lit(value))).otherwise(put)
    kept = F.map_filter(plain, lambda n, _: ~F.map_contains_key(F.col("put"), n))
    rows = dealt(read(spark, sf, "part", "p_partkey"), "p_partkey").select(k, put.alias("put")).select("p_partkey", F.map_concat(kept, F.col("put")).alias("record"))
    s = lambda x: F.lit(x).cast("string")
    p = F.struct(s("src").alias("source_id"), s("prov").alias("provider"), s("2024-01-03T00:00:00Z").alias("retrieved_at"), s("ds").alias("dataset_id"), s("sha256:a").alias("dataset_hash"), s(None).alias("source_uri"), s("COMPLETE").alias("source_status"), F.lit(False).alias("partial_update"), s(None).alias("license_id"))
    out = validation.validated(rows, p)
    return out.select("p_partkey", F.array_join(F.transform("issues", lambda x: F.concat_ws(" ", x["path"], x["code"])), ",").alias("issues"), "accepted", F.col("object.norad_id").alias("norad_id"))


_AXIS = "pow(398600.4418 / pow(m * 2 * pi() / 86400, 2), 1.0 / 3)"


@query(
    f"""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE round(p_size / 3.0 + 0.3, 4) END AS m FROM part), a AS (SELECT *, {_AXIS} AS a FROM p),
c AS (SELECT *, CASE WHEN m IS NULL THEN 'no data' WHEN a * 0.99 - 6378.137 < 120 THEN 'DECAYING' WHEN a * 1.01 - 6378.137 > 50000 THEN 'HEO' WHEN m < 2.5 THEN 'GEO' WHEN m > 11 THEN 'LEO' ELSE 'MEO' END AS k FROM a)
SELECT CASE WHEN p_partkey % 4 = 0 THEN 'no data' ELSE p_brand END AS company, CASE WHEN p_partkey % 5 = 0 THEN 'no data' ELSE 'SAT ' || p_partkey END AS satellite_name, (10000 + p_partkey % 90000)::VARCHAR AS norad_id,
  CASE WHEN p_partkey % 3 = 0 THEN '2001-02-03' ELSE 'no data' END AS launch_date, k AS type, k AS orbit_class, round(m, 4) AS motion, round(1440.0 / m, 5) AS period_min, CASE WHEN m IS NULL THEN 'no data' ELSE 'said' END AS line2 FROM c"""
)
def legacy_records(spark, sf):
    """Parts as element sets, in the flat form of older files."""
    k = F.col("p_partkey")
    n = (k % 90000 + 10000).cast("string")
    motion = F.format_string("%11.8f", F.round(F.col("p_size") / 3.0 + 0.3, 4).cast("double"))
    two = F.when(k % 9 != 0, F.concat(F.lit("2 "), n, F.lit("  51.6000 010.0000 0100000 020.0000 030.0000 "), motion, F.lit(" 1")))
    rows = read(spark, sf, "part", "p_partkey", "p_brand", "p_size").select(
        F.when(k % 4 != 0, F.col("p_brand")).alias("company"), F.when(k % 5 != 0, F.concat(F.lit(" SAT "), k.cast("string"))).otherwise("  ").alias("name"), F.concat(F.lit("1 "), n, F.lit("U 98067A")).alias("line1"), two.alias("line2"), "p_partkey"
    )
    dates = rows.where("p_partkey % 3 = 0").select(C.tle_norad("line1").alias("norad_id"), F.explode(F.array(F.lit("2001-02-03"), F.lit("1999-01-01"))).alias("launch_date"))
    out = OC.legacy_records(rows, dates)
    return out.select("company", "satellite_name", "norad_id", "launch_date", "type", "orbit_class", F.round("mean_motion_rev_per_day", 4).alias("motion"), F.round("period_min", 5).alias("period_min"), F.when(F.col("tle_line2") == "no data", "no data").otherwise("said").alias("line2"))
