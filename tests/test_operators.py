import itertools
import math
import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from perigee.functions import hashing, rf, sgp4
from perigee.functions import catalog as C
from perigee.operators import catalog as OC
from perigee.operators import ephemeris, propagation, refinement, screening, timeline
from perigee.sources import elements
from perigee.streaming import folds

# A published verification case of the propagator.
VANGUARD = (
    "1 00005U 58002B   00179.78495062  .00000023  00000-0  28098-4 0  4753",
    "2 00005  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413667",
)
VANGUARD_STATES = {
    0.0: (7022.46529266, -1400.08296755, 0.03995155, 1.893841015, 6.405893759, 4.534807250),
    360.0: (-7154.03120202, -3783.17682504, -3536.19412294, 4.741887409, -4.151817765, -2.093935425),
    4320.0: (-9060.47373569, 4658.70952502, 813.68673153, -2.232832783, -4.110453490, -3.157345433),
}


def test_published_states(spark):
    one = spark.createDataFrame([("v", *VANGUARD)], "id string, line1 string, line2 string")
    states = propagation.propagate(propagation.elements_of(one).withColumn("minutes", F.explode(F.array(*map(F.lit, VANGUARD_STATES)))))
    got = {r.minutes: r for r in states.collect()}
    for t, want in VANGUARD_STATES.items():
        assert got[t].code == "ok"
        assert all(abs(a - b) < 1e-5 for a, b in zip((got[t].x, got[t].y, got[t].z, got[t].vx, got[t].vy, got[t].vz), want))
    assert one.select(C.tle_checksum("line1")).first()[0] == 3


def test_propagation_codes():
    _, _, code = sgp4.propagate([50.0, 0.05, 50.0, 50.0], [0.0] * 4, [0.001, 0.0002, 1.5, 0.001], [0.0] * 4, [0.0] * 4, [15.0, 1.0027, 15.0, float("nan")], [0.0] * 4, [0.0] * 4)
    assert [sgp4.CODES[c] for c in code] == ["ok", "deep_space", "bad_elements", "not_finite"]


def test_tle_blocks(spark):
    a, b = VANGUARD
    text = "\n".join(["junk", "0 VANGUARD 1", a, b, "", "SECOND", a, b, "TAIL", a])
    got = elements.tle_blocks(spark.createDataFrame([("f", text), ("g", None), ("h", "")], "path string, text string")).collect()
    assert [(r.path, r.block, r.name) for r in got] == [("f", 0, "VANGUARD 1"), ("f", 1, "SECOND")]


OMM = """CCSDS_OMM_VERS = 2.0
COMMENT said
OBJECT_NAME = TEST
OBJECT_ID = 2020-001A
NORAD_CAT_ID = 00042
CENTER_NAME = EARTH
REF_FRAME = TEME
TIME_SYSTEM = UTC
MEAN_ELEMENT_THEORY = SGP4
EPOCH = 2024-01-01T00:00:00
MEAN_MOTION = 15.5
ECCENTRICITY = 0.001
INCLINATION = 51.6
RA_OF_ASC_NODE = 10
ARG_OF_PERICENTER = 20
MEAN_ANOMALY = 30
BSTAR = 0.0001
MEAN_MOTION_DOT = 0
MEAN_MOTION_DDOT = 0
"""


def test_omm(spark):
    cases = {"ok": OMM, "twice": OMM + "BSTAR = 1\n", "frame": OMM.replace("TEME", "GCRF"), "number": OMM.replace("= 0.001", "= 1.5"), "bare": "X", "null": None}
    got = {r.path: r for r in elements.omm_kvn(spark.createDataFrame(list(cases.items()), "path string, text string")).collect()}
    assert got["ok"].issue is None and got["ok"].norad_id == "42" and got["ok"].mean_motion == 15.5
    assert [got[k].issue for k in ("twice", "frame", "number", "bare", "null")] == ["DUPLICATE_FIELD", "FRAME_UNSUPPORTED", "NUMBER_INVALID", "KVN_MALFORMED", "VERSION_UNSUPPORTED"]


OEM = """CCSDS_OEM_VERS = 2.0
META_START
OBJECT_NAME = TEST
OBJECT_ID = 2020-001A
CENTER_NAME = EARTH
REF_FRAME = GCRF
TIME_SYSTEM = UTC
START_TIME = 2024-01-01T00:00:00
META_STOP
2024-01-01T00:00:00 7000 0 0 0 7.5 0
2024-01-01T00:01:00 6990 450 0 -0.5 7.4 0
"""


def test_oem(spark):
    cases = {"ok": OEM, "order": OEM + "2024-01-01T00:00:30 1 2 3 4 5 6\n", "tokens": OEM + "2024-01-01T00:02:00 1 2\n", "cov": OEM + "COVARIANCE_START\n", "start": OEM.replace("START_TIME = 2024-01-01T00:00:00", "START_TIME = 2024-01-02T00:00:00"), "null": None}
    described, states = elements.oem_states(spark.createDataFrame(list(cases.items()), "path string, text string"))
    issue = {r.path: r.issue for r in described.collect()}
    assert issue == {"ok": None, "order": "SAMPLE_ORDER_INVALID", "tokens": "SAMPLE_INVALID", "cov": "COVARIANCE_UNSUPPORTED", "start": "SAMPLE_INVALID", "null": "KVN_MALFORMED"}
    assert [(r.path, r.i, r.x) for r in states.orderBy("i").collect()] == [("ok", 0, 7000.0), ("ok", 1, 6990.0)]


def test_rate_limit(spark):
    calls = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 5.1), ("b", 2.0)], "k string, t double")
    got = [(r.k, r.t, r.admitted, r.retry_after_s) for r in folds.folded(calls, "k", ["t"], folds.rate_limit(2, 5.0)).orderBy("k", "t").collect()]
    assert got == [("a", 0.0, True, 0.0), ("a", 1.0, True, 0.0), ("a", 2.0, False, 3.0), ("a", 5.1, True, 0.0), ("b", 2.0, True, 0.0)]


def test_progress_flood(spark):
    flood = spark.range(2000).select(F.lit("job").alias("k"), F.col("id").cast("double").alias("t"), F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("stage"), (F.col("id") / 2000).alias("fraction"))
    got = folds.folded(flood, "k", ["t"], folds.coalesce_progress(0.0, 0.0, 16, 12)).where("persisted")
    kept = sorted(r.t for r in got.collect())
    assert len(kept) == 12 and kept[-1] == 1999.0  # one of the cap is reserved for the flush


def test_stream_equals_batch(spark, tmp_path):
    rows = [("ab"[i % 2], float(i), f"s{i % 3}", (i % 7) / 7) for i in range(40)]
    schema = "k string, t double, stage string, fraction double"
    spark.createDataFrame(rows[:20], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame(rows[20:], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    fold = folds.coalesce_progress(0.2, 1e9)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = folds.folded_stream(stream, "k", ["t"], fold).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("k", "t", "persisted", "fraction_so_far").collect()))
    batch = dataclasses.replace(fold, finish=None)  # a stream has no end
    want = sorted(map(tuple, folds.folded(spark.createDataFrame(rows, schema), "k", ["t"], batch).select("k", "t", "persisted", "fraction_so_far").collect()))
    assert got == want


def test_screening_equals_brute_force(spark):
    rnd = random.Random(5)
    objects = [(0, i, 10.0, *[rnd.uniform(-40, 40) for _ in range(3)]) for i in range(120)]
    objects = [(*o, *[x + rnd.uniform(-30, 30) for x in o[3:]]) for o in objects]
    schema = "slab long, id long, seconds double, " + ", ".join(f"{n}{a} double" for n in ("p0", "p1") for a in "xyz")
    cfg = screening.Screening(radius_km=5.0, cell_km=10.0)
    got = {(r.a, r.b): r.distance_km for r in screening.candidates(spark.createDataFrame(objects, schema), cfg).collect()}
    want = {}
    for p, q in itertools.combinations(objects, 2):
        r = [b - a for a, b in zip(p[3:6], q[3:6])]
        d = [(b1 - a1) - x for a1, b1, x in zip(p[6:], q[6:], r)]
        dd = sum(x * x for x in d)
        f = min(1.0, max(0.0, -sum(x * y for x, y in zip(r, d)) / dd)) if dd else 0.0
        m = math.sqrt(sum((x + y * f) ** 2 for x, y in zip(r, d)))
        if m <= 5.0:
            want[p[1], q[1]] = m
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_screening_drops_no_large_box(spark):
    """At the default cap: boxes of 8 cells, of thousands, and of nearly the whole space, in two slabs."""
    rnd = random.Random(6)
    objects = []
    for i in range(90):
        reach = (5, 300, 4000)[i % 3]
        p = [rnd.uniform(-500, 500) for _ in range(3)]
        objects.append((i % 2, i, 10.0, *p, *[x + rnd.uniform(-reach, reach) for x in p]))
    schema = "slab long, id long, seconds double, " + ", ".join(f"{n}{a} double" for n in ("p0", "p1") for a in "xyz")
    cfg = screening.Screening(radius_km=5.0, cell_km=10.0)
    states = spark.createDataFrame(objects, schema)
    assert screening.swept_boxes(states, cfg).where(F.col("cells") > cfg.max_cells_per_object).count() > 40
    got = [(r.i, r.j) for r in screening.box_pairs(states, cfg).select(F.col("a.id").alias("i"), F.col("b.id").alias("j")).collect()]
    box = lambda o: [(min(x, y) - 2.5, max(x, y) + 2.5) for x, y in zip(o[3:6], o[6:])]
    want = {(p[1], q[1]) for p, q in itertools.combinations(objects, 2) if p[0] == q[0] and all(a[0] <= b[1] and b[0] <= a[1] for a, b in zip(box(p), box(q)))}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("dense,rows", [(5, 7), (64, 4096), (10**9, 4096)])
def test_screening_of_a_dense_cell(spark, dense, rows):
    """A third of all objects in one cell, in two clumps; large boxes cross it; the rest is thin."""
    rnd = random.Random(7)
    objects = []
    for i in range(360):
        if i % 3 == 0:
            base, spread, reach = (5300 if i % 2 else 5700, 30, 4)
        elif i % 3 == 1:
            base, spread, reach = (0, 20_000, 300)
        else:
            base, spread, reach = (5300, 900, 40 if i % 4 else 6000)
        p = [base + rnd.uniform(-spread, spread) for _ in range(3)]
        objects.append((0, i, 10.0, *p, *[x + rnd.uniform(-reach, reach) for x in p]))
    schema = "slab long, id long, seconds double, " + ", ".join(f"{n}{a} double" for n in ("p0", "p1") for a in "xyz")
    cfg = screening.Screening(radius_km=3.0, cell_km=1000.0, dense_cell=dense, meeting_rows=rows)
    states = spark.createDataFrame(objects, schema)
    box = lambda o: [(min(x, y) - 1.5, max(x, y) + 1.5) for x, y in zip(o[3:6], o[6:])]
    want = {(p[1], q[1]) for p, q in itertools.combinations(objects, 2) if all(a[0] <= b[1] and b[0] <= a[1] for a, b in zip(box(p), box(q)))}
    got = [(r.i, r.j) for r in screening.box_pairs(states, cfg).select(F.col("a.id").alias("i"), F.col("b.id").alias("j")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    load = screening.slab_load(states, cfg).collect()
    met = screening.meetings(screening.swept_boxes(states, cfg), cfg).count()
    assert [(r.objects, r.spatial_pair_checks) for r in load] == [(360, met)]
    if dense == 64:
        plain = dataclasses.replace(cfg, dense_cell=10**9)
        assert met < 0.6 * screening.meetings(screening.swept_boxes(states, plain), plain).count()


def test_dedup_is_a_fold(spark):
    events = [("p", 1000, 5.0, "a", 0, 2000), ("p", 1500, 4.0, "b", 900, 2500), ("p", 2300, 4.5, "c", 1400, 3000), ("p", 9000, 1.0, "d", 8000, 9500)]
    got = screening.dedup_events(spark.createDataFrame(events, "pair_key string, tca_ms long, miss_km double, event_id string, lo_ms long, hi_ms long"), 1.0)
    assert sorted(r.event_id for r in got.collect()) == ["b", "d"]


def test_dedup_keeps_one_event_per_pair(spark, capsys):
    """A hot pair over several batches equals a plain loop, and no group is gathered."""
    rnd = random.Random(4)
    events = [("hot" if i % 3 else f"p{i % 40}", rnd.randrange(3_000_000), rnd.choice([0.5, 1.0, 2.0, None]), f"e{i}", 0, 0) for i in range(3000)]
    events = [(*e[:4], e[1] - rnd.randrange(900), e[1] + rnd.randrange(900)) for e in events]
    want, last = set(), {}
    for e in sorted(events, key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0, e[3])):
        k = last.get(e[0])
        if k and k[5] >= e[4] and e[5] >= k[4] and e[1] - k[1] <= 1000:
            if e[2] is not None and k[2] is not None and e[2] < k[2]:
                want.discard(k[3])
                want.add(e[3])
                last[e[0]] = e
        else:
            want.add(e[3])
            last[e[0]] = e
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        folded = screening.dedup_events(spark.createDataFrame(events, "pair_key string, tca_ms long, miss_km double, event_id string, lo_ms long, hi_ms long"), 1.0)
        got = [r.event_id for r in folded.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(set(got)) < len(events) and set(got) == want
    folded.explain()
    assert "collect_list" not in capsys.readouterr().out


def test_link_budget(spark):
    r = spark.range(1).select(rf.fspl_db(1000.0, 12.0).alias("l"), rf.noise_dbw(100e6).alias("n"), rf.delay_ms(1000.0).alias("d"), rf.fspl_db(-1.0, 12.0).alias("none")).first()
    assert abs(r.l - 174.03) < 0.02 and abs(r.n + 123.98) < 0.05 and abs(r.d - 3.3356) < 1e-4 and r.none is None


def test_upsert(spark):
    schema = "k string, epoch timestamp, ord long"
    old = spark.sql("select * from values ('a', timestamp'2024-01-02', 0L), ('b', null, 1L), ('c', timestamp'2024-01-05', 2L) t(k, epoch, ord)").select("k", F.col("epoch").cast("timestamp").alias("epoch"), "ord")
    new = spark.sql("select * from values ('a', timestamp'2024-01-01', 3L), ('b', timestamp'2020-01-01', 4L), ('d', timestamp'2024-01-01', 5L) t(k, epoch, ord)").select("k", F.col("epoch").cast("timestamp").alias("epoch"), "ord")
    got = {r.k: (r.ord, r.outcome) for r in OC.upsert(old, new, "k", "epoch", "ord").collect()}
    assert got == {"a": (0, "retained"), "b": (4, "updated"), "c": (2, "retained"), "d": (5, "added")}
    assert OC.upsert(spark.createDataFrame([], schema), spark.createDataFrame([], schema), "k", "epoch", "ord").count() == 0


def test_decay_dates(spark):
    d = spark.createDataFrame([("12/18/2023",), ("2023-02-30",), ("13/01/2023",), ("2023-12-18",), (None,)], "d string")
    assert [str(r[0]) for r in d.select(timeline.decay_date("d")).collect()] == ["2023-12-18", "None", "None", "2023-12-18", "None"]


def test_interpolation_never_extrapolates(spark):
    s = spark.sql("select 'o' as k, timestamp'2024-01-01 00:00:00' as ts, 0D as x union all select 'o', timestamp'2024-01-01 00:10:00', 10D union all select 'o', timestamp'2024-01-01 05:00:00', 20D")
    p = spark.sql("select 'o' as k, timestamp'2024-01-01 00:05:00' as ts union all select 'o', timestamp'2024-01-01 03:00:00' union all select 'o', timestamp'2024-01-02 00:00:00' union all select 'q', timestamp'2024-01-01 00:05:00'")
    got = [(r.k, r.status, r.x) for r in ephemeris.interpolate(ephemeris.bracket(s, p, "k", "ts", ["x"]), "ts", ["x"]).orderBy("k", "ts").collect()]
    assert got == [("o", "ok", 5.0), ("o", "gap", None), ("o", "out_of_range", None), ("q", "out_of_range", None)]


@pytest.mark.parametrize("text,want", [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")])
def test_fnv(spark, text, want):
    f = next(v for k, v in vars(hashing).items() if k.startswith("fnv"))
    assert spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0] == want


def test_refinement_equals_closed_form(spark):
    rnd = random.Random(8)
    motions = [[rnd.uniform(-20, 20) for _ in range(3)] + [rnd.uniform(-5, 5) for _ in range(3)] for _ in range(60)]
    state = "struct<id:string,t0_ms:long,px:double,py:double,pz:double,vx:double,vy:double,vz:double>"
    rows = [(0, 20_000, 0, 20_000, True, ("a", 0, *[0.0] * 6), (str(i), 0, *m)) for i, m in enumerate(motions)]
    rows.append((0, 20_000, 0, 20_000, True, ("a", 0, *[0.0] * 6), ("lost", 0, *[float("nan")] * 6)))
    pairs = spark.createDataFrame(rows, f"start_ms long, end_ms long, screen_start_ms long, screen_end_ms long, last boolean, a {state}, b {state}")
    got = {r.b: r for r in refinement.refine(pairs, refinement.Refinement(radius_km=12.0)).collect()}
    for i, m in enumerate(motions):
        p, v = m[:3], m[3:]
        t = min(20.0, max(0.0, -sum(x * y for x, y in zip(p, v)) / sum(y * y for y in v)))
        miss = math.sqrt(sum((x + y * t) ** 2 for x, y in zip(p, v)))
        assert (str(i) in got) == (miss <= 12.0)
        if miss <= 12.0:
            assert abs(got[str(i)].tca_ms - t * 1000) <= 1.0 and got[str(i)].converged and got[str(i)].boundary == (t in (0.0, 20.0))
    assert got["lost"].tca_ms is None


def test_provider_json(spark):
    import json

    good = {"provider": "Ex Co", "object_id": "A 1", "frame": "ITRF", "time_scale": "UTC", "interpolation": "LINEAR", "units": {"position": "km", "velocity": "km/s"}, "states": [{"timestamp": f"2024-01-01T00:0{i}:00Z", "position": [7000.0, i, 0.0], "velocity": [0.0, 7.5, 0.0]} for i in range(3)]}
    cases = {"ok": good, "units": good | {"units": {"position": "m"}}, "scale": good | {"time_scale": "TAI"}, "order": good | {"states": good["states"][::-1]}, "short": good | {"states": good["states"][:1]}, "method": good | {"interpolation": "HERMITE"}}
    rows = [(k, json.dumps(v)) for k, v in cases.items()] + [("null", None), ("junk", "{")]
    described, states = elements.provider_states(spark.createDataFrame(rows, "path string, text string"))
    got = {r.path: (r.identity, r.issue) for r in described.collect()}
    assert got["ok"] == ("obx:provider:ex-co:a-1", None)
    assert {k: v[1] for k, v in got.items() if v[1]} == {"units": "UNITS_UNSUPPORTED", "scale": "TIME_SYSTEM_UNSUPPORTED", "order": "SAMPLE_ORDER_INVALID", "short": "SAMPLE_INVALID", "method": "INTERPOLATION_UNSUPPORTED", "null": "RECORD_MALFORMED", "junk": "RECORD_MALFORMED"}
    assert [(r.i, r.x, r.y) for r in states.orderBy("i").collect()] == [(0, 7000.0, 0.0), (1, 7000.0, 1.0), (2, 7000.0, 2.0)]
