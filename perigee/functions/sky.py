"""Bodies, stars and paths: approximate ephemerides, appearance, sampling of orbits, beams on the ground."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.functions import constants as K
from perigee.functions import geometry as G

# Circular orbits of the Moon, the Earth and Mars (km, days, degrees at J2000).
MOON_KM, MOON_DAYS = 384_400.0, 27.321661
EARTH_KM, EARTH_DAYS = 149_597_870.7, 365.256363004
MARS_KM, MARS_DAYS, MARS_PHASE_DEG = 227_939_200.0, 686.98, 44.0

# How a satellite's orbit is sampled.
ORBIT_MINUTES, LEAST_MINUTES, MOST_MINUTES = 96.0, 1.0, 45 * 1440.0
LEAST_SAMPLES, MOST_SAMPLES, MINUTES_A_SAMPLE = 96, 720, 4.0
LEAST_REFRESH_MS, MOST_REFRESH_MS = 60_000.0, 300_000.0
PATH_SEGMENTS, PATH_FRACTION = 512, 0.95


def _circle(radius: float, days: float, jd: Column, phase: float = 0.0) -> G.Vector:
    angle = ((jd - K.J2000_JD) * (2 * math.pi / days) + phase) % (2 * math.pi)
    return radius * F.cos(angle), radius * F.sin(angle), F.lit(0.0)


def moon_eci(jd: Column) -> G.Vector:
    """The Moon on a circle in the equator's plane, km."""
    return _circle(MOON_KM, MOON_DAYS, jd)


def mars_eci(jd: Column) -> G.Vector:
    """Mars from the Earth, both on circles, km."""
    return G.sub(_circle(MARS_KM, MARS_DAYS, jd, math.radians(MARS_PHASE_DEG)), _circle(EARTH_KM, EARTH_DAYS, jd))


def star_size(magnitude: Column, limit: float = 10.0) -> tuple[Column, Column]:
    """Point size and opacity of a star."""
    lit = F.least(F.greatest((limit - F.least(F.greatest(magnitude, F.lit(-1.5)), F.lit(limit))) / (limit + 1.5), F.lit(0.0)), F.lit(1.0))
    return 1.1 + F.pow(lit, F.lit(1.7)) * 9.5, 0.18 + F.pow(lit, F.lit(1.25)) * 0.82


def star_kelvin(bv: Column) -> Column:
    """Temperature of a colour index; a missing one counts as 0.65."""
    x = 0.92 * F.least(F.greatest(F.coalesce(bv, F.lit(0.65)), F.lit(-0.4)), F.lit(2.2))
    return 4600.0 * (1 / (x + 1.7) + 1 / (x + 0.62))


def star_rgb(kelvin: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue from 0 to 1 of a black body."""
    t = F.least(F.greatest(kelvin, F.lit(1000.0)), F.lit(40000.0)) / 100.0
    cool, far = t <= 66, F.greatest(t - 60, F.lit(1e-9))
    red = F.when(cool, 255.0).otherwise(329.698727446 * F.pow(far, F.lit(-0.1332047592)))
    green = F.when(cool, 99.4708025861 * F.log(t) - 161.1195681661).otherwise(288.1221695283 * F.pow(far, F.lit(-0.0755148492)))
    blue = F.when(~cool, 255.0).when(t <= 19, 0.0).otherwise(138.5177312231 * F.log(F.greatest(t - 10, F.lit(1e-9))) - 305.0447927307)
    return tuple(F.least(F.greatest(c / 255.0, F.lit(0.0)), F.lit(1.0)) for c in (red, green, blue))


def orbit_minutes(motion_rad_min: Column) -> Column:
    """The period, or a usual one where it can't be."""
    p = F.try_divide(F.lit(2 * math.pi), motion_rad_min)
    return F.when(p.between(LEAST_MINUTES, MOST_MINUTES), p).otherwise(ORBIT_MINUTES)


def orbit_samples(minutes: Column) -> Column:
    n = F.least(F.greatest(F.ceil(minutes / MINUTES_A_SAMPLE), F.lit(LEAST_SAMPLES)), F.lit(MOST_SAMPLES))
    return F.when(minutes > 0, n).otherwise(LEAST_SAMPLES).cast("int")


def orbit_refresh_ms(minutes: Column, samples: Column) -> Column:
    every = minutes * 60_000.0 / F.greatest(samples, F.lit(1))
    return F.when(every > 0, F.least(F.greatest(every, F.lit(LEAST_REFRESH_MS)), F.lit(MOST_REFRESH_MS))).otherwise(LEAST_REFRESH_MS)


def orbit_path(bodies: DataFrame, axis: str, e: str, inclination: str, segments: int = PATH_SEGMENTS) -> DataFrame:
    """``bodies`` with i, x, y, z: points of the ellipse at equal steps of the true anomaly."""
    steps = bodies.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    x, y, z = G.inclined_ellipse(F.col(axis), F.col(e), F.col(inclination), F.col("i") / F.lit(float(segments)) * (2 * math.pi))
    return steps.withColumns({"x": x, "y": y, "z": z})


def path_from_ephemeris(period_days: Column, first_ms: Column, last_ms: Column, samples: Column, satellite: Column) -> Column:
    """Whether tabulated positions cover enough of a period to draw a body's path; not for a body around another."""
    covered = (last_ms - first_ms) / F.lit(float(K.MS_DAY)) >= period_days * PATH_FRACTION
    return F.coalesce(covered & (samples >= 2) & ~satellite, F.lit(False))


def nearest_vertex(points: DataFrame, vertices: DataFrame, key: str, cell: float) -> DataFrame:
    """For each point the nearest vertex of its paths (key; segment, i, x, y, z): segment, i and distance.

    Vertices are bounded per key by the sampling of an orbit; the minimum is one aggregate, ties
    going to the first segment and point.  A point without vertices is left out.
    """
    p = points.select(key, *[F.col(a).alias(f"_{a}") for a in "xyz"])
    away = G.norm(tuple(F.col(a) - F.col(f"_{a}") for a in "xyz"))
    met = vertices.join(p, key).withColumn("_d", away).where(F.col("_d").isNotNull() & ~F.isnan("_d"))
    return met.groupBy(key).agg(F.min(F.struct(F.col("_d").alias("distance"), "segment", "i")).alias("n")).select(key, "n.*")


def beam_ground(altitude_km: Column, azimuth_deg: Column, elevation_deg: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Where a satellite's beam meets the ground (degrees); null past the limb."""
    el, az, a = F.radians(elevation_deg), F.radians(azimuth_deg), F.radians(lat)
    rho = F.asin(K.EARTH_RADIUS_KM / (K.EARTH_RADIUS_KM + altitude_km))
    seen = F.try_divide(F.sin(el), F.sin(rho))
    delta = math.pi / 2 - el - F.acos(F.when(F.abs(seen) <= 1, seen))
    out = F.asin(F.least(F.greatest(F.sin(a) * F.cos(delta) + F.cos(a) * F.sin(delta) * F.cos(az), F.lit(-1.0)), F.lit(1.0)))
    turn = F.atan2(F.sin(az) * F.sin(delta) * F.cos(a), F.cos(delta) - F.sin(a) * F.sin(out))
    ok = delta <= rho
    return F.when(ok, F.degrees(out)), F.when(ok, lon + F.degrees(turn))


def scene_geodetic(lat: Column, lon: Column, alt_km: Column | float, scale: float = 1.0) -> G.Vector:
    """Earth-fixed axes with the second one up: the third and second components change places."""
    x, y, z = G.geodetic_to_ecef(lat, lon, alt_km)
    return x * scale, z * scale, y * scale


def scene_geocentric(lat: Column, lon: Column, radius_km: Column, scale: float = 1.0) -> G.Vector:
    a, o = F.radians(lat), F.radians(lon)
    return radius_km * F.cos(a) * F.cos(o) * scale, radius_km * F.sin(a) * scale, radius_km * F.cos(a) * F.sin(o) * scale


def terminator_lat(sub_lat: Column, sub_lon: Column, lon: Column) -> Column:
    """Latitude on a meridian where the Sun, overhead at a point, stands on the horizon; degrees."""
    a = F.radians(F.when(F.abs(sub_lat) < 1e-6, F.lit(1e-6)).otherwise(sub_lat))
    return F.degrees(F.atan(-F.cos(F.radians(lon - sub_lon)) / F.tan(a)))


def tapered_factor(psi: Column, weights: list[float]) -> Column:
    """Magnitude of a line array with real weights, 1 where all add up in phase."""
    re = sum((w * F.cos(psi * i) for i, w in enumerate(weights)), F.lit(0.0))
    im = sum((w * F.sin(psi * i) for i, w in enumerate(weights)), F.lit(0.0))
    return F.sqrt(re * re + im * im) / F.lit(float(sum(abs(w) for w in weights)))


def volumetric_factor(psi: G.Vector, counts: tuple[int, int, int]) -> Column:
    """Factor of a box of elements: the product of three uniform lines."""
    out = F.lit(1.0)
    for p, n in zip(psi, counts, strict=True):
        out = out * G.line_array_factor(p, n)
    return out
