"""Tabulated ephemerides from files to states at given times and into a screening; star and SATCAT files."""

import datetime
import json

import pytest

from perigee.operators import catalog_screening as CS
from perigee.operators import screening
from perigee.sources import elements, records, stars

T0 = datetime.datetime(2024, 1, 1)
START = 1_704_067_200_000


def provider(i, n=5, step=600, speed=1.0):
    states = [{"timestamp": (T0 + datetime.timedelta(seconds=k * step)).isoformat() + "Z", "position": [7000.0 + speed * k * step, float(i), 0.0], "velocity": [speed, 0.0, 0.0]} for k in range(n)]
    return json.dumps({"provider": "Some Lab", "object_id": f"obj {i}", "frame": "ITRF", "time_scale": "UTC", "interpolation": "LINEAR", "units": {"position": "km", "velocity": "km/s"}, "states": states})


OEM = """CCSDS_OEM_VERS = 2.0
CREATION_DATE = 2024-01-01T00:00:00
ORIGINATOR = TEST
META_START
OBJECT_NAME = ONE
OBJECT_ID = 1998-067A
CENTER_NAME = EARTH
REF_FRAME = GCRF
TIME_SYSTEM = UTC
START_TIME = 2024-01-01T00:00:00
STOP_TIME = 2024-01-01T00:10:00
META_STOP
2024-01-01T00:00:00 7000 0 0 0 7.5 0
2024-01-01T00:10:00 7100 10 0 0 7.4 0
"""


def test_both_formats(spark):
    texts = spark.createDataFrame([("a", provider(1)), ("b", provider(2)), ("c", provider(2, 3)), ("d", "{"), ("e", None)], "path string, text string")
    objects, states = records.adapt_ephemerides(texts, "PROVIDER_EPHEMERIS_JSON")
    got = {r.path: r for r in objects.collect()}
    assert got["a"].issue is None and got["a"].frame == "ITRF" and got["a"].n_states == 5 and got["a"].object_id.endswith("some-lab:obj-1")
    assert got["b"].issue == got["c"].issue == "DUPLICATE_OBJECT_ID" and got["d"].issue is not None and got["e"].issue is not None
    assert {r.object_id for r in states.collect()} == {got["a"].object_id} and states.count() == 5
    objects, states = records.adapt_ephemerides(spark.createDataFrame([("o", OEM)], "path string, text string"), "OEM_KVN")
    r = objects.collect()[0]
    assert (r.issue, r.frame, r.n_states) == (None, "GCRF", 2) and r.object_id.endswith("cospar:1998-067a") and states.count() == 2
    with pytest.raises(ValueError):
        records.adapt_ephemerides(texts, "TLE")


def test_states_at_times_and_into_slabs(spark):
    texts = spark.createDataFrame([("a", provider(1)), ("b", provider(2, 2, 4000))], "path string, text string")
    _, states = records.adapt_ephemerides(texts, "PROVIDER_EPHEMERIS_JSON")
    run = CS.Run(START, START + 2_400_000, 600.0, max_acceleration_km_s2=1e-6)
    times = spark.createDataFrame([(T0 + datetime.timedelta(seconds=s),) for s in (0, 600, 900, 1200, 1800, 2400, 2401)], "ts timestamp")
    at = records.tabulated_at(states, times)
    got = {(r.object_id[-1], int((r.ts - T0).total_seconds())): r for r in at.collect()}
    assert got["1", 900].code == "ok" and got["1", 900].x == pytest.approx(7900) and got["1", 900].vx == 1.0
    assert got["1", 2401].code == "out_of_range" and got["1", 2401].x is None
    assert got["2", 900].code == "gap" and got["2", 900].x is None and got["2", 0].code == "ok"
    slabs = CS.slabs(CS.grid_states(at, run))
    assert sorted((r.slab, r.p0x, r.p1x) for r in screening.sane(slabs, 1e-6).collect()) == [(k, pytest.approx(7000 + 600 * k), pytest.approx(7600 + 600 * k)) for k in range(4)]


def test_star_and_satcat_files(spark, tmp_path):
    (tmp_path / "stars.csv").write_text("name,raDeg,raHours,decDeg,mag,bv\nA,10.5,,20,1.0,0.2\nB,,2,-5,6.4,\nC,1,,,2,0\nD,1,,1,6.5,0\nE,x,,1,1,0\n")
    got = {r.name: r for r in stars.read_stars(spark, str(tmp_path / "stars.csv")).collect()}
    assert set(got) == {"A", "B"} and got["A"].ra_deg == 10.5 and got["B"].ra_deg == pytest.approx(30) and got["B"].bv is None
    (tmp_path / "satcat.csv").write_text("OBJECT_NAME,OBJECT_ID,NORAD_CAT_ID,OBJECT_TYPE,LAUNCH_DATE,LAUNCH_SITE,DECAY_DATE\nR,1,1,R/B,,,2001-01-01\nP,2,2, pay ,,,2002-02-02\nQ,3,3,PAY,,, \nS,4,4,,,,2001-01-01\n")
    assert [r.OBJECT_NAME for r in elements.satcat_decayed(spark, str(tmp_path / "satcat.csv")).collect()] == ["P"]
