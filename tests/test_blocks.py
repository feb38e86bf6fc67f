"""Blocked windows against plain loops, with one key that has nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from perigee.operators import blocks, ephemeris, screening


@pytest.fixture(scope="module")
def series():
    """Key h has 2,000 of 2,200 rows; keys of one row; a null key."""
    r = random.Random(12)
    out = []
    for key, n in (("h", 2000), ("a", 150), ("b", 40), ("one", 1), (None, 9)):
        v, t = 10.0, 0
        for _ in range(n):
            t += r.choice([1, 1, 2, 30])
            v = v if r.random() < 0.35 else v + r.choice([-1.0, 1.0, 2.0, -2.0])
            out.append((key, t, v, r.random() < 0.7))
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, series):
    return spark.createDataFrame(series, "k string, t long, v double, ok boolean")


def by_key(series):
    out = {}
    for k, t, v, ok in sorted(series, key=lambda x: (str(x[0]), x[1])):
        out.setdefault(k, []).append((t, v, ok))
    return out


@pytest.mark.parametrize("n", [1, 7, 40])
def test_carried(table, series, n):
    rows = blocks.blocked(table, ["k"], ["t"], n)
    if n > 1:
        sizes = [r["count"] for r in rows.groupBy(blocks.BLOCK).count().collect()]
        assert rows.where("k = 'h'").select(blocks.BLOCK).distinct().count() >= n - 3 and max(sizes) < 3 * 2200 / n
    some = F.when(F.col("ok"), F.col("v"))
    got = blocks.carried(rows, ["k"], ["t"], last={"l": some}, first={"f": some}, total={"s": F.col("v")})
    strict = blocks.carried(rows, ["k"], ["t"], last={"l": some}, first={"f": some}, own=False)
    a, b = ({(r.k, r.t): r for r in x.collect()} for x in (got, strict))
    assert len(a) == len(b) == len(series)
    for k, x in by_key(series).items():
        total = 0.0
        for i, (t, v, _) in enumerate(x):
            total += v
            before, after = [y for _, y, ok in x[: i + 1] if ok], [y for _, y, ok in x[i:] if ok]
            assert (a[k, t].l, a[k, t].f, a[k, t].s) == (before[-1] if before else None, after[0] if after else None, pytest.approx(total))
            before, after = [y for _, y, ok in x[:i] if ok], [y for _, y, ok in x[i + 1 :] if ok]
            assert (b[k, t].l, b[k, t].f) == (before[-1] if before else None, after[0] if after else None)


def test_brackets_of_a_hot_key(spark, table, series):
    samples = table.where("ok").select("k", "t", "v").unionByName(table.where("ok and t % 5 = 0").select("k", "t", (F.col("v") + 1).alias("v")))
    probes = table.select("k", (F.col("t") + F.col("t") % 3 - 1).alias("t"), F.lit("x").alias("note")).distinct()
    got = {(r.k, r.t): r for r in ephemeris.bracket(samples, probes, "k", "t", ["v"]).collect()}
    have = by_key(series)
    assert len(got) == probes.count()
    for (k, t), r in got.items():
        s = [(x, v) for x, v, ok in have[k] if ok]
        left, right = [y for y in s if y[0] <= t], [y for y in s if y[0] >= t]
        assert (r.t0, r.v0) == (left[-1] if left else (None, None)) and (r.t1, r.v1) == (right[0] if right else (None, None)) and r.note == "x"


def test_segments_of_a_hot_key(table, series):
    got = {(r.k, r.t): r.segment for r in ephemeris.segments(table, "k", "t", F.col("ok")).collect()}
    want = {}
    for k, x in by_key(series).items():
        number, i = 0, 0
        while i < len(x):
            j = i
            while j < len(x) and x[j][2]:
                j += 1
            if j - i > 1:
                number += 1
                want.update({(k, t): number for t, _, _ in x[i:j]})
            i = max(j, i + 1)
    assert got == want


def test_minima_of_a_hot_key(table, series):
    got = sorted((str(r.k), r.start, r.end, r.value) for r in screening.local_minima(table, ["k"], "t", "v").collect())
    want = []
    for k, x in by_key(series).items():
        runs = []
        for t, v, _ in x:
            if runs and abs(v - runs[-1][3]) <= 1e-12 * max(1, abs(v), abs(runs[-1][3])):
                runs[-1][1], runs[-1][3] = t, v
            else:
                runs.append([t, t, v, v])
        for i, (a, b, v, _) in enumerate(runs):
            left, right = runs[i - 1][2] if i else None, runs[i + 1][2] if i + 1 < len(runs) else None
            if (left is None and (right is None or right >= v)) or (right is None and left is not None and left > v) or (left is not None and right is not None and left > v and right > v):
                want.append((str(k), a, b, v))
    assert got == sorted(want) and len(want) > 100


def test_nothing(spark, table):
    none = table.limit(0)
    assert ephemeris.segments(none, "k", "t", F.col("ok")).count() == 0 and screening.local_minima(none, ["k"], "t", "v").count() == 0
    assert ephemeris.bracket(none, table.select("k", "t"), "k", "t", ["v"]).where("t0 is not null or t1 is not null").count() == 0
