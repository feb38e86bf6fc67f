"""Queries over bodies, stars, paths, beams and links, with the SQL that must agree."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from perigee.functions import constants as K
from perigee.functions import geometry as G
from perigee.functions import rf, sky
from perigee.operators import catalog_screening, ephemeris, propagation, screening
from perigee.plans.queries import dealt, _CHORD, _POINTS, _points, _rv, _states, query, read, rounded
from perigee.sources import records as sources

_JD = "(epoch_ms(o_orderdate) / 86400000.0 + 2440587.5 - 2451545.0)"
_MOON, _EARTH = f"fmod({_JD} * (2 * pi() / 27.321661), 2 * pi())", f"fmod({_JD} * (2 * pi() / 365.256363004), 2 * pi())"
_MARS = f"fmod({_JD} * (2 * pi() / 686.98) + radians(44.0), 2 * pi())"


@query(
    f"SELECT o_orderkey, round(384400.0 * cos({_MOON}), 2) AS moon_x, round(384400.0 * sin({_MOON}), 2) AS moon_y, round((227939200.0 * cos({_MARS}) - 149597870.7 * cos({_EARTH})) / 1000, 2) AS mars_x, round((227939200.0 * sin({_MARS}) - 149597870.7 * sin({_EARTH})) / 1000, 2) AS mars_y FROM orders"
)
def moon_and_mars(spark, sf):
    jd = G.julian_day(F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    moon, mars = sky.moon_eci(jd), sky.mars_eci(jd)
    return read(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", *[F.round(c, 2).alias(n) for n, c in (("moon_x", moon[0]), ("moon_y", moon[1]), ("mars_x", mars[0] / 1000), ("mars_y", mars[1] / 1000))])


_T = "least(greatest((10.0 - least(greatest(m, -1.5), 10.0)) / 11.5, 0.0), 1.0)"
_KELVIN = "(4600.0 * (1 / (0.92 * b + 1.7) + 1 / (0.92 * b + 0.62)))"


@query(
    f"""WITH s AS (SELECT vec_id, embedding[1]::DOUBLE * 12 AS m, least(greatest(embedding[2]::DOUBLE * 2.5, -0.4), 2.2) AS b FROM embeddings), k AS (SELECT *, {_KELVIN} AS kelvin, least(greatest({_KELVIN}, 1000.0), 40000.0) / 100.0 AS t FROM s),
c AS (SELECT *, CASE WHEN t <= 66 THEN 255.0 ELSE 329.698727446 * pow(greatest(t - 60, 1e-9), -0.1332047592) END AS r, CASE WHEN t <= 66 THEN 99.4708025861 * ln(t) - 161.1195681661 ELSE 288.1221695283 * pow(greatest(t - 60, 1e-9), -0.0755148492) END AS g,
  CASE WHEN t > 66 THEN 255.0 WHEN t <= 19 THEN 0.0 ELSE 138.5177312231 * ln(greatest(t - 10, 1e-9)) - 305.0447927307 END AS b2 FROM k)
SELECT vec_id, round(1.1 + pow({_T}, 1.7) * 9.5, 5) AS size, round(0.18 + pow({_T}, 1.25) * 0.82, 5) AS alpha, round(kelvin, 3) AS kelvin, round(least(greatest(r / 255.0, 0.0), 1.0), 5) AS r, round(least(greatest(g / 255.0, 0.0), 1.0), 5) AS g, round(least(greatest(b2 / 255.0, 0.0), 1.0), 5) AS b FROM c"""
)
def star_appearance(spark, sf):
    e = read(spark, sf, "embeddings", "vec_id", "embedding")
    m, bv = F.col("embedding")[0].cast("double") * 12, F.col("embedding")[1].cast("double") * 2.5
    size, alpha = sky.star_size(m)
    kelvin = sky.star_kelvin(bv)
    r, g, b = sky.star_rgb(kelvin)
    return e.select("vec_id", F.round(kelvin, 3).alias("kelvin"), *rounded(size=size, alpha=alpha, r=r, g=g, b=b))


_PERIOD = "(2 * pi() / ((p_size % 25) / 100.0))"


@query(
    f"""WITH o AS (SELECT p_partkey, CASE WHEN p_size % 25 > 0 AND {_PERIOD} BETWEEN 1 AND 64800 THEN {_PERIOD} ELSE 96.0 END AS m FROM part), n AS (SELECT *, least(greatest(ceil(m / 4.0), 96), 720)::INTEGER AS samples FROM o)
SELECT p_partkey, round(m, 5) AS minutes, samples, round(least(greatest(m * 60000.0 / samples, 60000.0), 300000.0), 3) AS refresh_ms FROM n""".replace("(2 * pi() / ((p_size % 25) / 100.0))", "(2 * pi() / nullif((p_size % 25) / 100.0, 0))")
)
def orbit_sampling(spark, sf):
    m = sky.orbit_minutes(F.col("p_size") % 25 / 100.0)
    n = sky.orbit_samples(m)
    return read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", F.round(m, 5).alias("minutes"), n.alias("samples"), F.round(sky.orbit_refresh_ms(m, n), 3).alias("refresh_ms"))


@query(
    """WITH b AS (SELECT n_nationkey, 1.0 + n_nationkey / 10.0 AS a, n_nationkey / 50.0 AS e, n_nationkey * 2.0 AS inc, unnest(range(0, 512)) AS i FROM nation), r AS (SELECT *, i / 512.0 * (2 * pi()) AS nu, a * (1 - e * e) / (1 + e * cos(i / 512.0 * (2 * pi()))) AS r FROM b)
SELECT n_nationkey, i::INTEGER AS i, round(r * cos(nu), 5) + 0.0 AS x, round(r * sin(nu) * sin(radians(inc)), 5) + 0.0 AS y, round(r * sin(nu) * cos(radians(inc)), 5) + 0.0 AS z FROM r"""
)
def orbit_paths(spark, sf):
    n = F.col("n_nationkey")
    b = read(spark, sf, "nation", "n_nationkey").select("n_nationkey", (1.0 + n / 10.0).alias("a"), (n / 50.0).alias("e"), (n * 2.0).alias("inc"))
    p = sky.orbit_path(b, "a", "e", "inc")
    return p.select("n_nationkey", "i", *rounded(x=F.col("x"), y=F.col("y"), z=F.col("z")))


@query("SELECT p_partkey, coalesce((p_size * 1.0) >= (p_partkey % 60) * 0.95 AND p_partkey % 3 >= 1 AND p_partkey % 7 <> 0, false) AS tabulated FROM part")
def path_eligibility(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", sky.path_from_ephemeris((k % 60).cast("double"), F.lit(0.0), F.col("p_size") * float(K.MS_DAY), k % 3 + 1, k % 7 == 0).alias("tabulated"))


@query(
    """WITH p AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), v AS (SELECT label, vec_id % 4 AS segment, vec_id AS i, embedding[4]::DOUBLE AS x, embedding[5]::DOUBLE AS y, embedding[6]::DOUBLE AS z FROM embeddings),
q AS (SELECT label, max_by(x, -vec_id) AS x, max_by(y, -vec_id) AS y, max_by(z, -vec_id) AS z FROM p GROUP BY label),
d AS (SELECT label, segment, i, sqrt((v.x - q.x) * (v.x - q.x) + (v.y - q.y) * (v.y - q.y) + (v.z - q.z) * (v.z - q.z)) AS distance FROM v JOIN q USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, segment, i) AS k FROM d)
SELECT label, segment, i, round(distance, 6) AS distance FROM r WHERE k = 1"""
)
def nearest_vertices(spark, sf):
    e = read(spark, sf, "embeddings", "vec_id", "embedding", "label")
    at = lambda k: [F.col("embedding")[k + j].cast("double").alias(a) for j, a in enumerate("xyz")]
    points = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select("label", *at(0))
    vertices = e.select("label", (F.col("vec_id") % 4).alias("segment"), F.col("vec_id").alias("i"), *at(3))
    return sky.nearest_vertex(points, vertices, "label", 1.0).select("label", "segment", "i", F.round("distance", 6).alias("distance"))


_RHO, _EL = "asin(6378.137 / (6378.137 + alt))", "radians(el)"
_DELTA = f"(pi() / 2 - {_EL} - acos(CASE WHEN abs(sin({_EL}) / sin({_RHO})) <= 1 THEN sin({_EL}) / sin({_RHO}) END))"


@query(
    f"""WITH {_POINTS}, b AS (SELECT *, 500.0 + s_suppkey * 10 % 2000 AS alt, (s_suppkey * 53 % 360)::DOUBLE AS az, (s_suppkey * 17 % 90)::DOUBLE AS el FROM points), d AS (SELECT *, {_DELTA} AS delta, {_RHO} AS rho FROM b),
g AS (SELECT *, asin(least(greatest(sin(radians(lat)) * cos(delta) + cos(radians(lat)) * sin(delta) * cos(radians(az)), -1.0), 1.0)) AS o FROM d)
SELECT s_suppkey, CASE WHEN delta <= rho THEN round(degrees(o), 5) END AS beam_lat, CASE WHEN delta <= rho THEN round(lon + degrees(atan2(sin(radians(az)) * sin(delta) * cos(radians(lat)), cos(delta) - sin(radians(lat)) * sin(o))), 5) END AS beam_lon FROM g"""
)
def beam_on_ground(spark, sf):
    k = F.col("s_suppkey")
    lat, lon = sky.beam_ground(500.0 + k * 10 % 2000, (k * 53 % 360).cast("double"), (k * 17 % 90).cast("double"), F.col("lat"), F.col("lon"))
    return _points(spark, sf).select("s_suppkey", *rounded(beam_lat=lat, beam_lon=lon))


_N = "(6378.137 / sqrt(1 - e2 * sin(radians(lat)) * sin(radians(lat))))"


@query(
    f"""WITH {_POINTS}, e AS (SELECT *, {K.WGS84_E2!r} AS e2 FROM points)
SELECT s_suppkey, round(({_N} + 400) * cos(radians(lat)) * cos(radians(lon)) / 1000, 5) AS x, round(({_N} * (1 - e2) + 400) * sin(radians(lat)) / 1000, 5) AS y, round(({_N} + 400) * cos(radians(lat)) * sin(radians(lon)) / 1000, 5) AS z,
  round(7000 * sin(radians(lat)), 5) AS up, round(degrees(atan(-cos(radians(lon - 30)) / tan(radians(20.0)))), 5) AS terminator, round(cos(radians(lat)) * cos(radians(lon)), 5) AS star_x, round(sin(radians(lat)), 5) AS star_z FROM e"""
)
def scene_axes(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    x, y, z = sky.scene_geodetic(lat, lon, 400.0, 0.001)
    star = G.sky_vector(lon, lat)
    return _points(spark, sf).select("s_suppkey", *rounded(x=x, y=y, z=z, up=sky.scene_geocentric(lat, lon, F.lit(7000.0))[1], terminator=sky.terminator_lat(F.lit(20.0), F.lit(30.0), lon), star_x=star[0], star_z=star[2]))


_WEIGHTS = [0.5, 1.0, 1.0, 0.5]
_RE, _IM = (" + ".join(f"{w} * {f}(p * {i})" for i, w in enumerate(_WEIGHTS)) for f in ("cos", "sin"))


@query(
    f"""WITH s AS (SELECT i, 3.0 * sin(radians(i / 2.0)) AS p FROM range(-180, 181) AS t(i)), u AS (SELECT *, CASE WHEN abs(sin(p / 2)) < 1e-9 THEN 1.0 ELSE abs(sin(2 * p) / (4 * sin(p / 2))) END AS a FROM s)
SELECT i AS step, round(sqrt(({_RE}) * ({_RE}) + ({_IM}) * ({_IM})) / 3.0, 5) AS tapered, round(a * a * a, 5) AS volumetric FROM u"""
)
def shaped_arrays(spark, sf):
    psi = 3.0 * F.sin(F.radians(F.col("id") / 2.0))
    return spark.range(-180, 181).select(F.col("id").alias("step"), *rounded(tapered=sky.tapered_factor(psi, _WEIGHTS), volumetric=sky.volumetric_factor((psi, psi, psi), (4, 4, 4))))


@query(
    """SELECT l_orderkey, l_linenumber, round(35 - 10 * log10(l_quantity * 10), 5) AS g_over_t, round(-100 + 35 - 10 * log10(l_quantity * 10) + 228.6 - 10 * log10(l_extendedprice), 5) AS eb_over_n0, round(-((l_discount - 0.05) * 10000 / 299792458.0) * 12e9, 3) + 0.0 AS doppler_hz,
  round(-10 * log10(cos(radians(l_quantity))), 5) AS scan_loss_db, round(pow(10.0, l_tax), 5) AS watts, round((l_extendedprice - l_quantity) * 1000.0 / 60, 5) AS radial_mps FROM lineitem"""
)
def link_quality(spark, sf):
    d = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    q = F.col("l_quantity")
    gt = rf.g_over_t(35.0, q * 10)
    eb = rf.eb_over_n0(rf.c_over_n0(F.lit(-100.0), gt), F.col("l_extendedprice"))
    out = rounded(g_over_t=gt, eb_over_n0=eb, scan_loss_db=rf.scan_loss_db(q), watts=rf.dbw_to_watts(rf.dbm_to_dbw(rf.dbw_to_dbm(F.col("l_tax") * 10))), radial_mps=G.radial_velocity_mps(q, F.col("l_extendedprice"), 60))
    return d.select("l_orderkey", "l_linenumber", F.round(rf.doppler_hz((F.col("l_discount") - 0.05) * 10000, 12e9), 3).alias("doppler_hz"), *out)


@query(
    """WITH a AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN 0.5 ELSE (p_size - 1) * 0.5 + 0.5 END AS x, 7 * 0.5 + 0.5 AS y FROM part)
SELECT p_partkey, round(greatest(0.35, least(120.0, 58.0 / greatest(x, y))), 5) AS beamwidth_deg FROM a"""
)
def array_beamwidth(spark, sf):
    return read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", F.round(G.array_beamwidth_deg(F.col("p_size"), F.lit(8), F.lit(0.5)), 5).alias("beamwidth_deg"))


@query(f"WITH {_POINTS} SELECT s_suppkey, round(least(greatest(lat::DOUBLE, -85.05112878), 85.05112878), 5) AS lat, round(lon::DOUBLE, 5) AS lon FROM points")
def mercator_roundtrip(spark, sf):
    p = _points(spark, sf)
    x, y = G.mercator(F.col("lon"), F.col("lat"), 1024, 512)
    lon, lat = G.mercator_inverse(x, y, 1024, 512)
    return p.select("s_suppkey", *rounded(lat=lat, lon=lon))


_BODY = "b AS (SELECT user_id, ts, min(value) AS v FROM events GROUP BY user_id, ts), q AS (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 7 HOUR AS t FROM events), k AS (SELECT user_id, t FROM q CROSS JOIN (VALUES (1), (2)) AS u(user_id))"
_MS = "(epoch_us({}) // 1000)"


@query(
    f"""WITH {_BODY}, l AS (SELECT k.user_id, k.t, b.ts AS t0, b.v AS v0 FROM k ASOF LEFT JOIN b ON k.user_id = b.user_id AND k.t >= b.ts), x AS (SELECT l.*, b.ts AS t1, b.v AS v1 FROM l ASOF LEFT JOIN b ON l.user_id = b.user_id AND l.t <= b.ts),
i AS (SELECT user_id, t, CASE WHEN t0 IS NULL OR t1 IS NULL THEN NULL WHEN {_MS.format('t1')} > {_MS.format('t0')} THEN v0 + (v1 - v0) * ({_MS.format('t')} - {_MS.format('t0')}) / ({_MS.format('t1')} - {_MS.format('t0')})::DOUBLE ELSE v0 END AS v FROM x)
SELECT epoch_ms(e.t) AS t_ms, CASE WHEN e.v IS NULL OR m.v IS NULL THEN 'out_of_range' ELSE 'ok' END AS status, round(m.v - e.v, 5) AS relative FROM i e JOIN i m ON e.t = m.t WHERE e.user_id = 1 AND m.user_id = 2"""
)
def moon_relative(spark, sf):
    """One tabulated body's position relative to another at common times."""
    e = read(spark, sf, "events", "user_id", "ts", "value").select("user_id", F.col("ts").alias("t"), F.col("value").alias("v"))
    times = e.select((F.date_trunc("day", F.col("t").cast("timestamp")) + F.expr("interval 7 hours")).cast("timestamp_ntz").alias("t")).distinct()
    probes = times.withColumn("user_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    at = ephemeris.interpolate(ephemeris.bracket(e.where("user_id in (1, 2)"), probes, "user_id", "t", ["v"]), "t", ["v"], None)
    earth, moon = (at.where(F.col("user_id") == k).select("t", F.col("status").alias(f"s{k}"), F.col("v").alias(f"v{k}")) for k in (1, 2))
    both = earth.join(moon, "t")
    status = F.when((F.col("s1") == "ok") & (F.col("s2") == "ok"), "ok").otherwise("out_of_range")
    return both.select(F.unix_millis(F.col("t").cast("timestamp")).alias("t_ms"), status.alias("status"), F.round(F.col("v2") - F.col("v1"), 5).alias("relative"))


# screening -----------------------------------------------------------------------


@query(f"WITH {_CHORD}, p AS (SELECT min(id) AS m FROM s) SELECT CASE WHEN a = m THEN b ELSE a END AS other, round(CASE WHEN a = m THEN fraction ELSE fraction END, 5) AS fraction, round(distance, 6) AS distance_km FROM c, p WHERE (a = m OR b = m) AND distance <= 0.5")
def selected_object_screen(spark, sf):
    """One object against all others, every interval tested without cells."""
    s = _states(spark, sf)
    primary = s.agg(F.min("id")).first()[0]
    near = catalog_screening.against_primary(s, primary, screening.Screening(radius_km=0.5))
    return near.select(F.col("b").alias("other"), F.round("fraction", 5).alias("fraction"), F.round("distance_km", 6).alias("distance_km"))


def _elements(spark, sf):
    """Pairs of circular orbits, two parts each, that cross where both are some minutes after epoch, a little apart."""
    p = read(spark, sf, "part", "p_partkey")
    k, second = F.floor(F.col("p_partkey") / 2), F.col("p_partkey") % 2 == 1
    tilt, half = F.lit(40.0) + k * 7 % 50, F.lit(10.0) + k * 11 % 60
    turn = F.radians(90.0 + half)
    along = F.degrees(F.atan2(F.sin(turn) / F.cos(F.radians(tilt)), F.cos(turn)))  # argument of latitude where the two planes meet
    motion = F.lit(14.0) + k % 15 / 10.0
    met = F.when(second, 180.0 - along).otherwise(along) - motion * 360.0 / 1440.0 * (F.lit(2.0) + k % 16) + F.when(second, k % 9 * 0.002).otherwise(0.0)
    return p.select(
        F.concat(F.lit(K.NORAD_SCHEME), F.col("p_partkey").cast("string")).alias("object_id"),
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("element_set_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("epoch"),
        tilt.cast("double").alias("inclination_deg"),
        ((k * 37 % 360) + F.when(second, half).otherwise(-half)).cast("double").alias("node_deg"),
        F.lit(0.0001).alias("eccentricity"),
        F.lit(0.0).alias("perigee_deg"),
        met.cast("double").alias("anomaly_deg"),
        motion.alias("motion_rev_day"),
        F.lit(0.0).alias("bstar"),
    )


def _run(radius: float = 5.0) -> catalog_screening.Run:
    start = 1_704_067_200_000
    return catalog_screening.Run(start, start + 1_200_000, 60.0, radius, 400.0)


@query()
def catalog_events(spark, sf):
    """From elements to events over a whole catalog; tests compare with brute force in the time domain."""
    e = catalog_screening.screen_catalog(_elements(spark, sf), _run())["events"]
    return e.select("pair_key", "event_id", "tca_ms", F.round("miss_km", 4).alias("miss_km"), "converged", "boundary")


@query()
def catalog_screen_statistics(spark, sf):
    return catalog_screening.screen_catalog(_elements(spark, sf), _run())["statistics"].withColumn("quality_flags", F.array_join("quality_flags", ","))


@query()
def object_events(spark, sf):
    e = _elements(spark, sf)
    return catalog_screening.screen_object(e, f"{K.NORAD_SCHEME}0", _run(50.0))["events"].select("pair_key", "tca_ms", F.round("miss_km", 4).alias("miss_km"))


@query()
def ground_tracks(spark, sf):
    s = propagation.propagate(propagation.on_grid(_elements(spark, sf), 0.0, 90.0, 30.0)).where("code = 'ok'")
    jd = G.julian_day(F.unix_millis("epoch") + F.col("minutes") * 60000.0)
    return propagation.ground_track(s, G.gmst(jd)).select("object_id", "minutes", *rounded(lat_deg=F.col("lat_deg"), lon_deg=F.col("lon_deg"), alt_km=F.col("alt_km")))


@query("SELECT p_partkey::VARCHAR AS path, p_partkey::VARCHAR AS norad_id, CASE WHEN p_partkey % 4 = 1 THEN 'NUMBER_INVALID' WHEN p_partkey % 4 = 2 THEN 'FRAME_UNSUPPORTED' END AS issue, CASE WHEN p_partkey % 4 IN (0, 3) THEN round(p_size / 4.0, 5) END AS motion FROM part")
def omm_records(spark, sf):
    """OMM objects in JSON, one file a part; keys in either case."""
    p = dealt(read(spark, sf, "part", "p_partkey", "p_size"), "p_partkey")
    k = F.col("p_partkey")
    said = {"ccsds_omm_vers": F.lit("2.0"), "CENTER_NAME": F.lit("EARTH"), "REF_FRAME": F.when(k % 4 == 2, "ICRF").otherwise("TEME"), "TIME_SYSTEM": F.lit("UTC"), "MEAN_ELEMENT_THEORY": F.lit("SGP4"), "NORAD_CAT_ID": k.cast("string"), "EPOCH": F.lit("2024-01-01T00:00:00.000")}
    said |= {"MEAN_MOTION": (F.col("p_size") / 4.0).cast("string"), "ECCENTRICITY": F.when(k % 4 == 1, "1.5").otherwise("0.01"), "INCLINATION": F.lit("51.6"), "RA_OF_ASC_NODE": F.lit("10"), "ARG_OF_PERICENTER": F.lit("20"), "MEAN_ANOMALY": F.lit("30"), "BSTAR": F.lit("0.0001"), "MEAN_MOTION_DOT": F.lit("0"), "MEAN_MOTION_DDOT": F.lit("0")}
    m = F.create_map(*[x for n, c in said.items() for x in (F.lit(n), c)])
    texts = p.select(k.cast("string").alias("path"), F.to_json(F.create_map(F.lit("records"), F.array(m))).alias("text"))
    found, _ = sources.adapt(texts, "OMM_JSON")
    return found.select("path", "norad_id", "issue", F.when(F.col("issue").isNull(), F.round("motion_rev_day", 5)).alias("motion"))


def tle_line(number, body: list) -> F.Column:
    """A line of columns with its checksum digit."""
    from perigee.functions import catalog as C

    text = F.concat(F.lit(number), *body)
    return F.concat(text, C.tle_checksum(text).cast("string"))


@query("SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 5 = 0 THEN 'TLE_LINE1_CHECKSUM_INVALID' END AS issue, CASE WHEN p_partkey % 5 <> 0 THEN (10000 + p_partkey)::VARCHAR END AS norad_id FROM part")
def tle_records(spark, sf):
    """Element sets as JSON records, one file a part, with a broken checksum in every fifth; lines hold the short form of long numbers."""
    p = dealt(read(spark, sf, "part", "p_partkey"), "p_partkey")
    k = F.col("p_partkey")
    n = (k + 10000).cast("string")
    letter = F.substring(F.lit("ABCDEFGHJKLMNPQRSTUVWXYZ"), F.expr("cast((p_partkey + 10000) div 10000 - 9 as int)"), F.lit(1))
    short = F.when(k + 10000 <= 99_999, n).when(k + 10000 <= 339_999, F.concat(letter, F.substring(n, -4, 4))).otherwise(F.substring(n, -5, 5))
    one = tle_line("1 ", [short, F.lit("U 98067A   24001.00000000  .00000000  00000-0  10000-3 0  999")])
    two = tle_line("2 ", [short, F.lit("  51.6000 010.0000 0010000 020.0000 030.0000 15.50000000    1")])
    wrong = F.concat(F.substring(one, 1, 68), ((F.substring(one, 69, 1).cast("int") + 1) % 10).cast("string"))
    record = F.struct(F.when(k % 5 == 0, wrong).otherwise(one).alias("tle_line1"), two.alias("TLE_LINE2"), n.alias("NORAD_CAT_ID"))
    found, _ = sources.adapt(p.select(k.cast("string").alias("path"), F.to_json(F.array(record)).alias("text")), "TLE")
    return found.select("path", "issue", F.when(F.col("issue").isNull(), F.col("norad_id")).alias("norad_id"))


@query("SELECT p_partkey, round(1440.0 / (p_size / 3.0), 5) AS period FROM part WHERE 1440.0 / (p_size / 3.0) >= 225")
def deep_space_periods(spark, sf):
    """Objects whose orbits need the Sun's and the Moon's pull: they have states where their epoch is known."""
    p = read(spark, sf, "part", "p_partkey", "p_size").withColumn("motion_rev_day", F.col("p_size") / 3.0).where("1440.0 / motion_rev_day >= 225")
    e = p.select("p_partkey", "motion_rev_day", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("epoch"), F.lit(30.0).alias("inclination_deg"), F.lit(40.0).alias("node_deg"), F.lit(0.01).alias("eccentricity"), F.lit(50.0).alias("perigee_deg"), F.lit(60.0).alias("anomaly_deg"), F.lit(0.0).alias("bstar"), F.lit(720.0).alias("minutes"))
    s = propagation.propagate(e).where("code = 'ok'")
    return s.select("p_partkey", F.round(1440.0 / F.col("motion_rev_day"), 5).alias("period"))
