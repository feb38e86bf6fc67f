"""Whole-catalog and one-object screening against brute force in the time domain, with errors, duplicates and limits."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.functions import sgp4
from perigee.operators import catalog_screening as CS
from perigee.operators import propagation, store
from perigee.plans.sky_queries import _elements
from perigee.sources import records

START = 1_704_067_200_000
SF = "/root/testdata/sf0.001"

# Published verification cases of the propagator's deep-space part: lines, and positions (km) at epoch and 120 minutes later.
DEEP = [
    ("1 28129U 03058A   06175.57071136 -.00000104  00000-0  10000-3 0   459", "2 28129  54.7298 324.8098 0048506 266.2640  93.1663  2.00562768 18443", (21707.46412351, -15318.61752390, 0.13551152), (18616.75971861, 3166.15177043, 18833.41523210)),
    ("1 26975U 78066F   06174.85818871  .00000620  00000-0  10000-3 0  6809", "2 26975  68.4714 236.1303 5602877 123.7484 302.5767  2.05657553 67521", (-14506.92313768, -21613.56043281, 10.05018894), (7309.62197950, 6076.00713664, 6800.08705263)),
    ("1 28626U 05008A   06176.46683397 -.00000205  00000-0  10000-3 0  2190", "2 28626   0.0019 286.9433 0000335  13.7918  55.6504  1.00270176  4891", (42080.71852213, -2646.86387436, 0.81851294), (37740.00085593, 18802.76872802, 3.45512584)),
    ("1 21897U 92011A   06176.02341244 -.00001273  00000-0 -13525-3 0  3044", "2 21897  62.1749 198.0096 7421690 253.0462  20.1561  2.01269994104880", (-14464.72135182, -4699.19517587, 0.06681686), (-19410.46286123, -19143.03318969, 23114.05522619)),
]


def test_deep_space(spark):
    table = spark.createDataFrame([(i, a, b, t) for i, (a, b, _, _) in enumerate(DEEP) for t in (0.0, 120.0)], "i long, line1 string, line2 string, minutes double")
    got = {(r.i, r.minutes): r for r in propagation.propagate(propagation.elements_of(table)).collect()}
    for i, (_, _, first, later) in enumerate(DEEP):
        for t, want in ((0.0, first), (120.0, later)):
            r = got[i, t]
            assert r.code == "ok" and max(abs(a - b) for a, b in zip((r.x, r.y, r.z), want)) < 0.005
    undated = propagation.propagate(propagation.elements_of(table).drop("epoch"))
    assert {r.code for r in undated.collect()} == {"deep_space"}


@pytest.fixture(scope="module")
def catalog(spark):
    return _elements(spark, SF).orderBy(F.substring_index("object_id", ":", -1).cast("int")).limit(24).cache()


def brute(rows, radius):
    """Local minima of all pairs on a grid of half seconds, polished on one of milliseconds."""
    t = np.arange(0, 1_200_001, 500)
    where = {}
    for r in rows:
        args = [np.full(len(t), x) for x in (r.inclination_deg, r.node_deg, r.eccentricity, r.perigee_deg, r.anomaly_deg, r.motion_rev_day, r.bstar)]
        where[r.object_id] = (r, sgp4.propagate(*args, t / 60000.0)[0])
    out = {}
    ids = sorted(where)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            d = np.sqrt(((where[a][1] - where[b][1]) ** 2).sum(1))
            for k in np.flatnonzero(d < radius + 8):
                if 0 < k < len(d) - 1 and d[k] <= d[k - 1] and d[k] < d[k + 1]:
                    fine = np.arange(t[k] - 500, t[k] + 501)
                    p = [sgp4.propagate(*[np.full(len(fine), x) for x in (r.inclination_deg, r.node_deg, r.eccentricity, r.perigee_deg, r.anomaly_deg, r.motion_rev_day, r.bstar)], fine / 60000.0)[0] for r in (where[a][0], where[b][0])]
                    e = np.sqrt(((p[0] - p[1]) ** 2).sum(1))
                    if e.min() <= radius:
                        out[a, b] = (START + int(fine[e.argmin()]), float(e.min()))
    return out


def test_catalog_against_brute_force(spark, catalog):
    run = CS.Run(START, START + 1_200_000, 60.0, 5.0, 100.0, max_results=3)
    want = brute(catalog.collect(), 5.0)
    assert len(want) >= 8
    old = catalog.where("element_set_id = 'e0'").withColumn("element_set_id", F.lit("older")).withColumn("epoch", F.lit("2023-12-01 00:00:00").cast("timestamp"))
    bad = catalog.where("element_set_id = 'e1'").withColumn("object_id", F.lit("broken")).withColumn("eccentricity", F.lit(None).cast("double"))
    out = CS.screen_catalog(catalog.unionByName(old).unionByName(bad), run)
    got = {tuple(sorted(r.pair_key.split("|"))): r for r in out["events"].collect()}
    assert set(got) == set(want)
    for k, (t, miss) in want.items():
        assert abs(got[k].tca_ms - t) <= 2 and abs(got[k].miss_km - miss) < 1e-4 and got[k].converged
        assert list(got[k].pair_key.split("|")) == sorted(got[k].pair_key.split("|"))
    s = out["statistics"].collect()[0]
    assert (s.catalog_objects, s.duplicate_catalog_objects_skipped, s.time_slabs, s.propagation_failures, s.status) == (25, 1, 20, 21, "PARTIAL")
    assert s.pair_intervals_total == 25 * 24 // 2 * 20 and s.pair_intervals_screened == 24 * 23 // 2 * 20 and s.motion_bound_violations == 0
    assert (s.events_detected, s.events_reported, s.events_truncated) == (len(want), 3, len(want) - 3)
    assert {"RESULT_LIMIT_APPLIED", "INCOMPLETE_PROPAGATION_COVERAGE", "DUPLICATE_CATALOG_OBJECTS_SKIPPED"} <= set(s.quality_flags)
    assert [r.tca_ms for r in out["reported"].collect()] == sorted(t for t, _ in want.values())[:3]
    assert out["errors"].count() == 21
    primary = sorted(want)[0][0]
    one = CS.screen_object(catalog, primary, run)
    assert {tuple(sorted(r.pair_key.split("|"))) for r in one["events"].collect()} == {k for k in want if primary in k}
    st = one["statistics"].collect()[0]
    assert st.pair_intervals_total == 23 * 20 and st.status == "COMPLETED"


def test_empty_catalog(spark, catalog):
    out = CS.screen_catalog(catalog.limit(0), CS.Run(START, START + 600_000))
    assert out["events"].count() == 0 and out["statistics"].collect()[0].catalog_objects == 0


# stores and sources -------------------------------------------------------------


def test_supersession(spark):
    rows = [("b", None), ("a", "b"), ("c", None), ("d", "x"), ("p", "q"), ("q", "p"), ("s", "r"), ("t", "r"), ("r", None)]
    got = {r.id: r for r in store.supersession_order(spark.createDataFrame(rows, "id string, up string"), "id", "up").collect()}
    assert {i: r.issue for i, r in got.items()} == {"a": None, "b": None, "c": None, "d": None, "p": "CYCLE", "q": "CYCLE", "r": "BRANCH", "s": None, "t": None}
    order = sorted((i for i in "abcd"), key=lambda i: (got[i].sort_id, got[i].depth))
    assert order == ["b", "a", "c", "d"]


def test_json_records(spark):
    cases = {
        "array": '[{"a": 1}, {"a": "x"}]', "wrapped": '{"records": [{"a": 1}]}', "one": '{"a": 1}', "ambiguous": '{"records": [{"a": 1}], "EPOCH": "x"}',
        "none": "[]", "broken": "{", "null": None, "scalar": "[1]",
    }
    files, rows = records.json_records(spark.createDataFrame(list(cases.items()), "path string, text string"))
    issue = {r.path: r.issue for r in files.collect()}
    assert issue["ambiguous"] == issue["none"] == issue["broken"] == issue["null"] == "INPUT_INVALID"
    assert issue["array"] is issue["wrapped"] is issue["one"] is None and issue["scalar"] is not None
    assert sorted((r.path, r.i) for r in rows.collect()) == [("array", 0), ("array", 1), ("one", 0), ("wrapped", 0)]


def test_snapshot(spark, tmp_path):
    import hashlib

    p = tmp_path / "x.json"
    p.write_text("[1]")
    good = records.snapshot(spark, str(p), "sha256:" + hashlib.sha256(b"[1]").hexdigest()).collect()[0]
    bad = records.snapshot(spark, str(p), "0" * 64).collect()[0]
    assert (good.text, good.issue, bad.text, bad.issue) == ("[1]", None, None, "DIGEST_MISMATCH")


def test_omm_text_and_states(spark):
    said = {"CCSDS_OMM_VERS": "2.0", "CENTER_NAME": "EARTH", "REF_FRAME": "TEME", "TIME_SYSTEM": "UTC", "MEAN_ELEMENT_THEORY": "SGP4", "OBJECT_NAME": "X", "NORAD_CAT_ID": "5", "EPOCH": "2024-01-01T00:00:00", "MEAN_MOTION": "15.5", "ECCENTRICITY": "0.001", "INCLINATION": "51.6", "RA_OF_ASC_NODE": "1", "ARG_OF_PERICENTER": "2", "MEAN_ANOMALY": "3", "BSTAR": "0", "MEAN_MOTION_DOT": "0", "MEAN_MOTION_DDOT": "0"}
    kvn = "\n".join(f"{k} = {v}" for k, v in said.items())
    texts = spark.createDataFrame([("a", kvn)], "path string, text string")
    satcat = spark.createDataFrame([("5", "PAY", "+")], "norad_id string, object_type string, lifecycle_status string")
    rows, _ = records.adapt(texts, "OMM_KVN", satcat)
    r = rows.collect()[0]
    assert (r.issue, r.object_type, r.epoch) == (None, "PAYLOAD", datetime.datetime(2024, 1, 1)) and r.element_set_id.startswith("elset:omm:")
    twice, _ = records.adapt(texts.unionByName(texts.withColumn("path", F.lit("b"))), "OMM_KVN")
    assert {x.issue for x in twice.collect()} == {"DUPLICATE_OBJECT_ID"}
    s = records.states_of(rows, 0.0).collect()[0]
    assert s.code == "ok" and 6000 < (s.x**2 + s.y**2 + s.z**2) ** 0.5 < 7500
    with pytest.raises(ValueError):
        records.adapt(texts, "?")
