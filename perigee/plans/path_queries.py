"""Queries over cut paths, dense catalogs, scanned files and published versions, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from perigee.operators import occlusion, planetary, screening
from perigee.operators.rounds import shared_path
from perigee.plans.queries import _S6, _rv, query, read, rounded
from perigee.plans.sky_queries import tle_line
from perigee.sources import scan, writers

_QUAD = f"""{_S6}, q AS (SELECT *, pow(d3 - d0, 2) + pow(d4 - d1, 2) + pow(d5 - d2, 2) AS a, 2 * (d0 * (d3 - d0) + d1 * (d4 - d1) + d2 * (d5 - d2)) AS b, d0 * d0 + d1 * d1 + d2 * d2 - 0.0225 AS c FROM s),
w AS (SELECT *, b * b - 4 * a * c AS disc, (-b - sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) AS enter, (-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) AS leave FROM q)"""


@query(
    f"""WITH {_QUAD}, p AS (
  SELECT *, 0 AS k, 0.0::DOUBLE AS t0, CASE WHEN disc <= 0 OR enter >= 1 OR leave <= 0 THEN 1.0 ELSE enter END AS t1 FROM w WHERE disc <= 0 OR enter >= 1 OR leave <= 0 OR enter > 0
  UNION ALL SELECT *, 1 AS k, leave AS t0, 1.0::DOUBLE AS t1 FROM w WHERE disc > 0 AND enter < 1 AND leave > 0 AND leave < 1)
SELECT id AS vec_id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS piece, round(t0, 5) AS t0, round(t1, 5) AS t1, round(d0 + (d3 - d0) * t0, 5) AS x0, round(d2 + (d5 - d2) * t1, 5) AS z1 FROM p"""
)
def clipped_segments(spark, sf):
    """Segments between the first and the second three numbers of each vector, cut by a sphere: none, one or two parts."""
    v = [F.col(f"d{i}") for i in range(6)]
    c = occlusion.clip_segments(_rv(spark, sf), tuple(v[:3]), tuple(v[3:]), 0.15)
    return c.select("vec_id", "piece", *rounded(t0=F.col("begin"), t1=F.col("end"), x0=F.col("x0"), z1=F.col("z1")))


_EYE = (0.0, 0.0, 0.6)


@query(
    f"""WITH {_S6}, q AS (SELECT id, id % 3 AS track, pow(d0, 2) + pow(d1, 2) + pow(d2 - 0.6, 2) AS a, 2 * 0.6 * (d2 - 0.6) AS b, 0.36 - 0.04 AS c FROM s),
w AS (SELECT id, track, a, b, b * b - 4 * a * c AS d FROM q),
o AS (SELECT id, track, NOT coalesce(CASE WHEN d > 0 THEN ((-b - sqrt(d)) / (2 * a) > 0 AND (-b - sqrt(d)) / (2 * a) < 1) OR ((-b + sqrt(d)) / (2 * a) > 0 AND (-b + sqrt(d)) / (2 * a) < 1) ELSE false END, false) AS seen FROM w),
g AS (SELECT *, sum(CASE WHEN seen THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY id) AS g FROM o), n AS (SELECT *, count(*) OVER (PARTITION BY track, g) AS n FROM g WHERE seen)
SELECT id AS vec_id, track, dense_rank() OVER (PARTITION BY track ORDER BY g) AS segment FROM n WHERE n > 1"""
)
def visible_path_runs(spark, sf):
    """Three paths through the vectors, seen past a sphere."""
    rows = _rv(spark, sf).withColumn("track", F.col("vec_id") % 3)
    seen = occlusion.visible_runs(rows, "track", "vec_id", tuple(F.col(f"d{i}") for i in range(3)), tuple(F.lit(x) for x in _EYE), 0.2)
    return seen.select("vec_id", "track", F.col("segment").cast("long").alias("segment"))


_DENSE = screening.Screening(radius_km=0.0005, cell_km=0.5, max_acceleration_km_s2=0.0, dense_cell=32)
_DENSE_SQL = "d AS (SELECT vec_id AS id, " + ", ".join(f"CASE WHEN vec_id % 3 = 0 THEN 0.3 + embedding[{i + 1}]::DOUBLE / 20 ELSE embedding[{i + 1}]::DOUBLE END AS p{i}, CASE WHEN vec_id % 3 = 0 THEN 0.3 + embedding[{i + 1}]::DOUBLE / 20 + embedding[{i + 4}]::DOUBLE / 200 ELSE embedding[{i + 1}]::DOUBLE + embedding[{i + 4}]::DOUBLE / 10 END AS q{i}" for i in range(3)) + " FROM embeddings)"
_DENSE_BOX = " AND ".join(f"least(a.p{i}, a.q{i}) - 0.000250001 <= greatest(b.p{i}, b.q{i}) + 0.000250001 AND least(b.p{i}, b.q{i}) - 0.000250001 <= greatest(a.p{i}, a.q{i}) + 0.000250001" for i in range(3))


@query(f"WITH {_DENSE_SQL} SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.id < b.id AND {_DENSE_BOX}")
def dense_cell_pairs(spark, sf):
    """Boxes that overlap where a third of all objects lies within one cell of the first level."""
    e = read(spark, sf, "embeddings", "vec_id", "embedding")
    dense = F.col("vec_id") % 3 == 0
    at = lambda i: F.col("embedding")[i].cast("double")
    ends = {}
    for i, x in enumerate("xyz"):
        start = F.when(dense, 0.3 + at(i) / 20).otherwise(at(i))
        ends |= {f"p0{x}": start, f"p1{x}": start + F.when(dense, at(i + 3) / 200).otherwise(at(i + 3) / 10)}
    states = e.select(F.lit(0).cast("long").alias("slab"), F.col("vec_id").alias("id"), F.lit(10.0).alias("seconds"), *[c.alias(n) for n, c in ends.items()])
    return screening.box_pairs(states, _DENSE).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query(
    """SELECT CASE WHEN p_partkey % 7 = 3 THEN 'stray line' ELSE 'OBJECT ' || p_partkey END AS name, (10000 + p_partkey % 80000)::VARCHAR AS norad_id, count(*) AS blocks
FROM part WHERE p_partkey % 7 <> 5 GROUP BY ALL"""
)
def scanned_elements(spark, sf):
    """Element sets of all parts written as text with stray lines among them, and scanned back by ranges."""
    k = F.col("p_partkey")
    n = (k % 80000 + 10000).cast("string")
    one = tle_line("1 ", [n, F.lit("U 98067A   24001.00000000  .00000000  00000-0  10000-3 0  999")])
    two = tle_line("2 ", [F.when(k % 7 == 5, F.lit("00001")).otherwise(n), F.lit("  51.6000 010.0000 0010000 020.0000 030.0000 15.50000000    1")])
    stray = F.when(k % 7 == 3, F.lit("stray line\n")).when(k % 7 == 4, F.lit("\n \n")).otherwise("")
    name = F.concat(F.lit("0 OBJECT "), k.cast("string"), F.lit("\n"))
    # a stray line that comes between name and lines takes the name's place
    text = F.concat(name, stray, one, F.lit("\n"), two)
    path = shared_path(spark, "elements-text")
    read(spark, sf, "part", "p_partkey").select(text.alias("value")).write.text(path)
    found = scan.tle_blocks(spark, path)
    return found.groupBy("name", F.trim(F.substring("line1", 3, 5)).alias("norad_id")).agg(F.count("*").alias("blocks"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0")
def published_version(spark, sf):
    """The second version of a table, as a reader of the pointer sees it; the first stays where it is."""
    o = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    base = shared_path(spark, "published")
    writers.publish({"orders": o.where("o_orderkey % 5 <> 0")}, base)
    writers.publish({"orders": o.where("o_orderkey % 3 <> 0")}, base)
    return writers.current(spark, base)["orders"]


# bodies of a table: users by remainder, days as instants, six multiples of the day's mean; body 3 has no even days
_BODIES = """b AS (SELECT 'b' || user_id % 4 AS body, date_trunc('day', ts) AS ts, avg(value) * 1.0471975512 AS v FROM events WHERE NOT (user_id % 4 = 3 AND day(ts) % 2 = 0) GROUP BY 1, 2)"""


def _bodies(spark, sf):
    e = read(spark, sf, "events", "user_id", "ts", "value").where(~((F.col("user_id") % 4 == 3) & (F.dayofmonth("ts") % 2 == 0)))
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    b = e.groupBy(F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("body"), day.alias("ts")).agg((F.avg("value") * 1.0471975512).alias("v"))
    return b.select("body", "ts", *[(F.col("v") * (i + 1)).alias(c) for i, c in enumerate(planetary.STATE)])


@query(
    f"""WITH {_BODIES}, n AS (SELECT count(DISTINCT ts) AS n FROM b)
SELECT body, count(*) AS samples, epoch_ms(min(ts)) AS first_ms, epoch_ms(max(ts)) AS last_ms, concat_ws(',', CASE WHEN count(*) < max(n.n) THEN 'AXIS_MISMATCH' END, CASE WHEN count(*) < 2 THEN 'TOO_FEW_INSTANTS' END) AS issues FROM b, n GROUP BY body"""
)
def planetary_axis(spark, sf):
    c = planetary.axis_check(_bodies(spark, sf))
    return c.select("body", "samples", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), F.array_join("issues", ",").alias("issues"))


_PROBED = f"""{_BODIES}, t AS (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 7 HOUR AS t FROM events), p AS (SELECT t, body FROM t, (SELECT DISTINCT body FROM b UNION ALL SELECT 'none')),
l AS (SELECT p.*, b.ts AS t0, b.v AS v0 FROM p ASOF LEFT JOIN b ON p.body = b.body AND p.t >= b.ts), r AS (SELECT l.*, b.ts AS t1, b.v AS v1 FROM l ASOF LEFT JOIN b ON l.body = b.body AND l.t <= b.ts),
s AS (SELECT t, body, CASE WHEN body = 'none' THEN 'unavailable' WHEN t0 IS NULL OR t1 IS NULL THEN 'out_of_range' ELSE 'ok' END AS status, v0 + (v1 - v0) * (epoch_ms(t) - epoch_ms(t0)) / (epoch_ms(t1) - epoch_ms(t0))::DOUBLE AS v FROM r)"""


def _probed(spark, sf):
    times = read(spark, sf, "events", "ts").select((F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("interval 7 hours")).alias("ts")).distinct()
    names = F.array(*[F.lit(x) for x in ("b0", "b1", "b2", "b3", "none")])
    return planetary.states_at(_bodies(spark, sf), times.withColumn("body", F.explode(names)))


@query(f"WITH {_PROBED} SELECT body, epoch_ms(t) AS t_ms, status, " + ", ".join(f"round(CASE WHEN status = 'ok' THEN v * {i + 1} END, 4) AS {c}" for i, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))) + " FROM s")
def planetary_states(spark, sf):
    """All bodies' six numbers at seven o'clock of every day."""
    return _probed(spark, sf).select("body", F.unix_millis("ts").alias("t_ms"), "status", *[F.round(c, 4).alias(c) for c in planetary.STATE])


@query(
    f"""WITH {_PROBED} SELECT a.body, epoch_ms(a.t) AS t_ms, CASE WHEN a.status <> 'ok' THEN a.status ELSE o.status END AS status, round(CASE WHEN a.status = 'ok' AND o.status = 'ok' THEN a.v - o.v END, 4) AS x,
  round(CASE WHEN a.status = 'ok' AND o.status = 'ok' THEN 6 * (a.v - o.v) END, 4) AS vz FROM s a JOIN s o ON a.t = o.t AND o.body = 'b0' WHERE a.body <> 'b0'"""
)
def planetary_relative(spark, sf):
    """Every other body as the first one sees it."""
    r = planetary.seen_from(_probed(spark, sf), "b0")
    return r.select("body", F.unix_millis("ts").alias("t_ms"), "status", F.round("x", 4).alias("x"), F.round("vz", 4).alias("vz"))
