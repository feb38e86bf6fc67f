"""Decay estimates against a walk over every point of the grids, one object at a time."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from perigee.functions import sgp4
from perigee.operators import decay

NOW = 1_704_067_200_000
DAY = 86_400_000
COLUMNS = "object_id string, epoch timestamp, inclination_deg double, node_deg double, eccentricity double, perigee_deg double, anomaly_deg double, motion_rev_day double, bstar double"


def walk(row, start, end, step, cfg):
    epoch = row[1].replace(tzinfo=datetime.timezone.utc).timestamp() * 1000
    t = np.arange(start, end + 1, step, dtype=float)
    p, _, code = sgp4.propagate(*(np.full(len(t), x) for x in row[2:]), (t - epoch) / 60000, np.full(len(t), epoch / DAY + 2440587.5))
    h = np.where(code == 0, decay.altitude(p), np.nan)
    hit = np.flatnonzero(~(h > cfg.reentry_km))
    return (int(t[hit[0]]), math.isnan(h[hit[0]])) if len(hit) else None, h


def by_hand(row, known, cfg):
    if known:
        return ("CONFIRMED", "Confirmed decay record", known, None, None, None)
    if None in row[1:]:
        return ("UNKNOWN", "Missing elements; cannot propagate", None, None, None, None)
    h = walk(row, NOW, NOW, 1, cfg)[1][0]
    if math.isnan(h):
        return ("CONFIRMED", "Propagation invalid near current epoch", NOW, None, None, None)
    if h > cfg.coarse_km:
        return ("UNKNOWN", f"Altitude {math.floor(h + 0.5)} km exceeds coarse decay search limit", None, None, None, None)
    why = lambda x: "Propagation failed" if x[1] else f"Altitude dropped below {cfg.reentry_km:g} km"
    x = walk(row, NOW - int(cfg.back_days * DAY), NOW, int(cfg.back_step_min * 60000), cfg)[0]
    if x:
        return ("CONFIRMED", why(x), x[0], None, None, None)
    x = walk(row, NOW, NOW + int(cfg.ahead_days * DAY), int(cfg.step_min * 60000), cfg)[0]
    if not x:
        return ("UNKNOWN", "Propagation stays above threshold within horizon", None, None, None, None)
    near = (cfg.ahead_days - (x[0] - NOW) / DAY) / cfg.ahead_days
    return ("PREDICTED", why(x), None, x[0] - DAY // 2, x[0] + DAY // 2, round(min(1.0, 0.35 + min(0.3, abs(row[-1]) * 1e5) + near / 2), 9))


def test_estimates_equal_the_whole_walk(spark):
    cfg = decay.Decay(back_days=20, ahead_days=60)
    rows = []
    for i, (n, b, ecc) in enumerate([(15.2, 1e-4, 1e-3), (15.9, 3e-4, 1e-3), (16.0, 1e-3, 1e-3), (16.1, 5e-3, 5e-4), (16.2, 1e-4, 1e-3), (16.3, 1e-3, 1e-4), (16.35, 0.0, 1e-4), (16.42, 1e-4, 1e-3), (9.0, 0.0, 0.01), (4.5, 1e-4, 0.66), (14.1, 1e-5, 1e-3), (15.7, -2e-4, 4e-3), (16.0, 8e-4, 0.01), (15.5, 2e-3, 0.03)]):
        rows.append((f"o{i}", datetime.datetime(2024, 1, 1) - datetime.timedelta(days=i % 4), 10.0 + 11 * i, 20.0 * i, ecc, 30.0 * i, 40.0 * i, n, b))
    rows.append(("sunk", datetime.datetime(2023, 6, 1), 50.0, 0.0, 1e-3, 0.0, 0.0, 16.2, 5e-3))
    rows += [("null", None, 50.0, 0.0, 1e-3, 0.0, 0.0, 15.0, 0.0), ("half", datetime.datetime(2024, 1, 1), 50.0, 0.0, None, 0.0, 0.0, 15.0, 0.0)]
    rows += [rows[3], ("known", *rows[0][1:]), ("both", *rows[1][1:])]
    confirmed = spark.createDataFrame([("known", 5), ("both", 7), ("both", 9), ("both", None), (None, 3), ("stranger", 1)], "object_id string, decay_ms long")
    table = spark.createDataFrame(rows, COLUMNS).withColumn("confidence", F.lit("clash")).withColumn("extra", F.lit(1))
    got = decay.estimates(table, NOW, confirmed, cfg=cfg).collect()
    assert len(got) == len(rows) and all(r.extra == 1 for r in got)
    seen = {}
    for r in got:
        seen.setdefault(r.object_id, []).append((r.decay_status, r.decay_reason, r.decay_ms, r.window_start_ms, r.window_end_ms, None if r.confidence is None else round(r.confidence, 9)))
    known = {"known": 5, "both": 9}
    for row in rows:
        want = by_hand(row, known.get(row[0]), cfg)
        assert set(seen[row[0]]) == {want}, row[0]
    assert len(seen["o3"]) == 2
    reasons = {x[0][1].split()[0] + x[0][0] for x in seen.values()}
    assert {"AltitudeUNKNOWN", "AltitudePREDICTED", "PropagationUNKNOWN", "MissingUNKNOWN", "ConfirmedCONFIRMED"} <= reasons and any(x.endswith("CONFIRMED") and not x.startswith("Confirmed") for x in reasons)


def test_most_blocks_are_passed_over(spark, monkeypatch):
    """A high orbit costs a state a block and not one a point."""
    calls = []
    plain = sgp4.propagate
    monkeypatch.setattr(sgp4, "propagate", lambda *a: calls.append(len(a[0])) or plain(*a))
    sky = decay._Sky(np.full(3, float(NOW)), [np.full(3, x) for x in (50.0, 0.0, 1e-3, 0.0, 0.0, 14.5, 1e-5)])
    at, _ = decay.first_crossing(sky, np.arange(3), NOW, NOW + 180 * DAY, 1_800_000, decay.Decay())
    assert (at == -1).all() and sum(calls) <= 3 * (8641 // decay.BLOCK + 3)


def test_low_orbits_without_drag_cost_no_walk(monkeypatch):
    """An orbit that stays a few kilometres above the threshold, and one that decays on the way."""
    calls = []
    plain = sgp4.propagate
    monkeypatch.setattr(sgp4, "propagate", lambda *a: calls.append(len(a[0])) or plain(*a))
    sky = decay._Sky(np.full(2, float(NOW)), [np.full(2, x) for x in (50.0, 0.0, 1e-3, 0.0, 0.0)] + [np.array([16.4, 16.2]), np.array([0.0, 1e-4])])
    at, _ = decay.first_crossing(sky, np.arange(2), NOW, NOW + 180 * DAY, 1_800_000, decay.Decay())
    assert at[0] == -1 and at[1] > NOW and sum(calls) < 1000


def test_a_failure_between_good_ends_is_found():
    """The eccentricity leaves its range within a block at whose ends there are states, high above the threshold."""
    elements = (150.9243985638815, 160.01384530005114, 6.331760555693388e-05, 271.8915241006045, 280.43175397327906, 16.17487493917273, 0.012040369573670523)
    sky = decay._Sky(np.full(1, float(NOW)), [np.full(1, x) for x in elements])
    at, failed = decay.first_crossing(sky, np.arange(1), NOW - 60 * DAY, NOW, 7_200_000, decay.Decay())
    assert (at[0], failed[0]) == (1_703_865_600_000, True)


def test_no_state_lies_under_the_bound():
    rng = np.random.default_rng(15)
    n = 200
    ecc = np.where(rng.random(n) < 0.5, 10 ** rng.uniform(-6, -1.5, n), rng.uniform(0, 0.6, n))
    motion = 86400 / (2 * np.pi * np.sqrt(((6378.135 + rng.uniform(80, 500, n)) / (1 - ecc)) ** 3 / sgp4.MU))
    elements = [rng.uniform(0, 180, n), rng.uniform(0, 360, n), ecc, rng.uniform(0, 360, n), rng.uniform(0, 360, n), motion, rng.choice([0, 1, -1], n) * 10 ** rng.uniform(-6, -1.5, n)]
    jd = np.full(n, 2460310.5)
    mean, bounded = sgp4.mean_orbits(*elements, jd), 0
    for start, end in ((-80_000.0, -78_000.0), (-700.0, 700.0), (0.0, 1440.0), (30_000.0, 31_440.0), (0.0, 200_000.0)):
        t = np.linspace(start, end, 60)
        position, _, code = sgp4.propagate(*(np.repeat(x, 60) for x in elements), np.tile(t, n), np.repeat(jd, 60))
        radius = np.sqrt((position**2).sum(1)).reshape(n, 60)
        floor = sgp4.least_radius(mean, np.arange(n), np.full(n, start), np.full(n, end))
        sure = ~np.isnan(floor)
        assert (code.reshape(n, 60)[sure] == 0).all() and (radius[sure].min(1) >= floor[sure] - 1e-6).all()
        bounded += sure.sum()
    assert bounded > n


def test_altitude_of_known_places():
    got = decay.altitude(np.array([[6378.137, 0, 0], [0, 0, 6356.7523142 + 100], [0, 6378.137 + 500, 0]]))
    assert np.abs(got - [0, 100, 500]).max() < 1e-6


def test_no_objects(spark):
    assert decay.estimates(spark.createDataFrame([], COLUMNS), NOW).count() == 0
