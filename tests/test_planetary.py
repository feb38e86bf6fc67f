"""Axis checks, states and relative states of a small table, by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from perigee.operators import planetary


def at(h):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)


SCHEMA = "body string, ts timestamp, x double, y double, z double, vx double, vy double, vz double"


def row(body, h, v=1.0):
    return (body, None if h is None else at(h), *[float(v * (i + 1)) for i in range(6)])


@pytest.fixture(scope="module")
def samples(spark):
    rows = [row(b, h, k + h) for k, b in enumerate(("sun", "earth", "moon")) for h in (0, 6, 12)]
    rows += [row("late", 6), row("late", 12), row("twice", 0), row("twice", 6), row("twice", 6), row("twice", 12), row("one", 0), row("nan", 0), row("nan", 6, float("nan")), row("nan", 12), row(None, 0), row("undated", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_axis(samples):
    got = {r.body: r for r in planetary.axis_check(samples).collect()}
    want = {"sun": [], "earth": [], "moon": [], "late": ["AXIS_MISMATCH"], "twice": ["DUPLICATE_INSTANT"], "one": ["AXIS_MISMATCH", "TOO_FEW_INSTANTS"], "nan": ["VECTOR_INVALID"], "undated": ["AXIS_MISMATCH", "TOO_FEW_INSTANTS", "VECTOR_INVALID"]}
    assert {b: r.issues for b, r in got.items()} == want and (got["late"].samples, got["late"].first, got["late"].last) == (2, at(6), at(12))
    assert planetary.axis_check(samples.limit(0)).count() == 0


def test_table_of_usable_bodies(samples):
    got = {r.ts: r.bodies for r in planetary.table(samples).collect()}
    assert sorted(got) == [at(0), at(6), at(12)] and all(set(b) == {"sun", "earth", "moon"} for b in got.values())
    assert got[at(6)]["moon"] == [8.0, 16.0, 24.0, 32.0, 40.0, 48.0]


def test_states_and_relative_states(spark, samples):
    asked = [(b, h) for b in ("sun", "earth", "moon", "late", "nan", "pluto") for h in (-1, 0, 3, 12, 13)] + [("earth", None), ("earth", 3)]
    probes = spark.createDataFrame([(b, None if h is None else at(h), i) for i, (b, h) in enumerate(asked)], "body string, ts timestamp, i long").withColumn("x", F.lit("clash"))
    got = {r.i: r for r in planetary.states_at(samples, probes).collect()}
    assert len(got) == len(asked)
    for i, (b, h) in enumerate(asked):
        r = got[i]
        if b == "pluto":
            assert r.status == "unavailable" and r.x is None
        elif h is None:
            assert r.status == "invalid_date" and r.x is None
        elif not (6 if b == "late" else 0) <= h <= 12:
            assert r.status == "out_of_range" and r.vz is None
        else:
            v = {"sun": h, "earth": 1 + h, "moon": 2 + h, "late": 1, "nan": 1}[b]
            assert r.status == "ok" and [r[c] for c in planetary.STATE] == pytest.approx([v * (k + 1) for k in range(6)])
    seen = {(r.body, r.i): r for r in planetary.seen_from(planetary.states_at(samples, probes), "sun").collect()}
    for (b, i), r in seen.items():
        h = asked[i][1]
        if b in ("earth", "moon") and h is not None and 0 <= h <= 12:
            d = 1 if b == "earth" else 2
            assert r.status == "ok" and (r.x, r.vz) == pytest.approx((d, 6 * d))
        elif b == "late" and h == 3:
            assert r.status == "out_of_range" and r.x is None
    assert not any(b == "sun" for b, _ in seen) and len(seen) == len(asked) - 5
