"""Segments cut by a sphere, by hand; visible stretches against a loop."""

import math
import random

from pyspark.sql import functions as F

from perigee.operators import occlusion

SCHEMA = "i long, px double, py double, pz double, qx double, qy double, qz double"


def ends():
    return [tuple(F.col(f"{n}{a}") for a in "xyz") for n in "pq"]


def test_none_one_two(spark):
    cases = {
        1: ((-3, 0, 0), (3, 0, 0), [(0, 1 / 3), (2 / 3, 1)]),  # through
        2: ((-3, 1, 0), (3, 1, 0), [(0, 1)]),  # touches
        3: ((-3, 2, 0), (3, 2, 0), [(0, 1)]),  # misses
        4: ((0, 0, 0), (2, 0, 0), [(0.5, 1)]),  # leaves
        5: ((2, 0, 0), (0, 0, 0), [(0, 0.5)]),  # enters
        6: ((0.5, 0, 0), (-0.5, 0.1, 0), []),  # inside
        7: ((2, 0, 0), (3, 0, 0), [(0, 1)]),  # behind
        8: ((-3, 0, 0), (-2, 0, 0), [(0, 1)]),  # ahead
        9: ((2, 0, 0), (2, 0, 0), [(0, 1)]),  # a point outside
        10: ((0.5, 0, 0), (0.5, 0, 0), []),  # a point inside
        11: ((1, 0, 0), (3, 0, 0), [(0, 1)]),  # begins on the border
        12: ((None, 0, 0), (3, 0, 0), []),
    }
    rows = [(i, *[None if x is None else float(x) for x in (*p, *q)]) for i, (p, q, _) in cases.items()]
    got = {}
    for r in occlusion.clip_segments(spark.createDataFrame([*rows, rows[0]], SCHEMA), *ends(), 1.0).collect():
        got.setdefault(r.i, set()).add((r.piece, round(r.begin, 9), round(r.end, 9), round(r.x0, 9), round(r.x1, 9)))
    for i, (p, q, want) in cases.items():
        mix = lambda t: round(p[0] + (q[0] - p[0]) * t, 9)  # noqa: B023, E731
        assert got.get(i, set()) == {(k, round(a, 9), round(b, 9), mix(a), mix(b)) for k, (a, b) in enumerate(want)}, i


def test_no_kept_point_is_inside(spark):
    r = random.Random(4)
    rows = [(i, *[r.uniform(-2, 2) for _ in range(6)]) for i in range(300)]
    pieces = {}
    for x in occlusion.clip_segments(spark.createDataFrame(rows, SCHEMA), *ends(), 1.0).collect():
        pieces.setdefault(x.i, []).append((x.begin, x.end))
    for i, *v in rows:
        for t in [k / 97 for k in range(98)]:
            out = math.dist([a + (b - a) * t for a, b in zip(v[:3], v[3:])], (0, 0, 0)) >= 1
            held = any(a - 1e-9 <= t <= b + 1e-9 for a, b in pieces.get(i, []))
            assert out == held or abs(math.dist([a + (b - a) * t for a, b in zip(v[:3], v[3:])], (0, 0, 0)) - 1) < 1e-6


def test_runs(spark):
    rows = [("k", t, 2 * math.cos(t / 20), 2 * math.sin(t / 20), 0.0) for t in range(260)] + [("gap", 1, 0.0, 3.0, 0.0), ("gap", 2, None, 0.0, 0.0), ("gap", 3, 0.0, 3.0, 0.0), ("gap", 4, 0.0, 3.1, 0.0)]
    track = spark.createDataFrame(rows, "k string, t long, x double, y double, z double")
    got = {}
    for r in occlusion.visible_runs(track, "k", "t", tuple(F.col(c) for c in "xyz"), (F.lit(5.0), F.lit(0.0), F.lit(0.0)), 1.0).collect():
        got.setdefault((r.k, r.segment), []).append(r.t)
    hidden = [t for t in range(260) if math.cos(t / 20) < 0 and abs(2 * math.sin(t / 20) * 5 / (5 - 2 * math.cos(t / 20))) < 5 / math.sqrt(24)]
    assert sorted(got) == [("gap", 1), ("k", 1), ("k", 2), ("k", 3)] and sorted(got["gap", 1]) == [3, 4]
    seen = sorted(t for (k, _), x in got.items() if k == "k" for t in x)
    assert seen == [t for t in range(260) if t not in hidden] and len(hidden) > 20
