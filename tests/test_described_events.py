"""Events with element sets, ages, states and flags, each by a row."""

import datetime

import numpy as np
import pytest

from perigee.functions import sgp4
from perigee.operators import catalog_screening as CS
from perigee.operators import propagation

T = 1_704_067_200_000
EPOCH = datetime.datetime(2024, 1, 1)
OBJECTS = "object_id string, element_set_id string, epoch timestamp, inclination_deg double, node_deg double, eccentricity double, perigee_deg double, anomaly_deg double, motion_rev_day double, bstar double, orbit_class string, name string, quality_flags array<string>"
ELEMENTS = (50.0, 10.0, 0.001, 20.0, 30.0, 15.0, 1e-5)


def thing(i, days=0, change=0.0, epoch=True, flags=(), klass="LEO"):
    e = list(ELEMENTS)
    e[4] += change
    return (i, f"set-{i}", EPOCH - datetime.timedelta(days=days) if epoch else None, *e, klass, i.upper(), list(flags))


@pytest.fixture(scope="module")
def got(spark):
    objects = [thing("a"), thing("twin"), thing("old", 9, 1.0), thing("new", -2, 2.0), thing("none", epoch=False, change=3.0), thing("marked", change=0.5, flags=["ODD", "EVEN"]), thing("geo", 9, 4.0, klass="GEO")]
    events = [(f"a|{b}", "a", b, T + 600_000, 3.0, True) for b in ("twin", "old", "new", "none", "marked", "geo", "missing")] + [("marked|old", "marked", "old", T, 2.0, False)]
    table = spark.createDataFrame(events, "pair_key string, a string, b string, tca_ms long, miss_km double, converged boolean")
    out = CS.described(table, spark.createDataFrame(objects, OBJECTS), CS.Run(T, T + 3_600_000), ("FULL_CATALOG_SNAPSHOT_SCREEN",))
    return {r.pair_key: r for r in out.collect()}


def test_flags(got):
    base = {"ACCELERATION_BOUND_COARSE_SCREEN", "COLLISION_PROBABILITY_UNAVAILABLE", "SAME_TIME_TEME_STATES", "SUBDIVIDED_LOCAL_MINIMUM_SEARCH", "TLE_SGP4_SCREENING_ONLY", "FULL_CATALOG_SNAPSHOT_SCREEN"}
    want = {
        "a|twin": {"COLOCATED_OR_COMMON_TLE_GEOMETRY"}, "a|old": {"SECONDARY_TLE_STALE_AT_TCA"}, "a|new": {"SECONDARY_TLE_EPOCH_AFTER_TCA"}, "a|none": {"SECONDARY_TLE_EPOCH_UNAVAILABLE"},
        "a|marked": {"SECONDARY_ODD", "SECONDARY_EVEN"}, "a|geo": set(), "marked|old": {"PRIMARY_ODD", "PRIMARY_EVEN", "SECONDARY_TLE_STALE_AT_TCA", "REFINEMENT_NOT_CONVERGED"},
    }
    assert set(got) == set(want)
    for k, flags in want.items():
        assert set(got[k].quality_flags) == base | flags and got[k].quality_flags == sorted(got[k].quality_flags), k


def test_ages_states_and_motion(got):
    r = got["a|old"]
    assert r.a_age_days == pytest.approx(600 / 86400) and r.b_age_days == pytest.approx(9 + 600 / 86400) and (r.a_element_set_id, r.b_name) == ("set-a", "OLD")
    p = []
    for change, minutes in ((0.0, 10.0), (1.0, 10.0 + 9 * 1440)):
        e = list(ELEMENTS)
        e[4] += change
        x, v, _ = sgp4.propagate(*[np.array([y]) for y in (*e, minutes)])
        p.append((x[0], v[0]))
    assert np.allclose(r.relative_position_km, p[1][0] - p[0][0], atol=1e-6) and np.allclose(r.relative_velocity_km_s, p[1][1] - p[0][1], atol=1e-9)
    assert r.relative_speed_km_s == pytest.approx(float(np.linalg.norm(p[1][1] - p[0][1])))
    assert got["a|none"].b_age_days == 0 and got["a|none"].relative_speed_km_s is None and got["a|twin"].relative_speed_km_s == 0
    assert len(propagation.ELEMENTS) == 7
