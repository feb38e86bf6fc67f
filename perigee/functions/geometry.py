"""Column functions for frames, look angles, beams, sky and orbits.  Vectors are tuples of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from perigee.functions import constants as K

Vector = tuple[Column, Column, Column]


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def along(a: Vector, d: Vector, f: Column) -> Vector:
    return tuple(x + y * f for x, y in zip(a, d, strict=True))


def unit(a: Vector) -> Vector:
    n = norm(a)
    return tuple(F.try_divide(x, n) for x in a)


def wrap_longitude(lon: Column) -> Column:
    return (lon + 540.0) % 360.0 - 180.0


def geodetic_to_ecef(lat: Column, lon: Column, alt_km: Column | float = 0.0) -> Vector:
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = K.WGS84_A_KM / F.sqrt(1 - K.WGS84_E2 * s * s)
    return (n + alt_km) * c * F.cos(F.radians(lon)), (n + alt_km) * c * F.sin(F.radians(lon)), (n * (1 - K.WGS84_E2) + alt_km) * s


def eci_to_ecef(v: Vector, gmst: Column) -> Vector:
    return v[0] * F.cos(gmst) + v[1] * F.sin(gmst), -v[0] * F.sin(gmst) + v[1] * F.cos(gmst), v[2]


def ecef_to_geodetic(v: Vector) -> dict[str, Column]:
    """Latitude, longitude, altitude by one Bowring step; null at the origin."""
    x, y, z = v
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * K.WGS84_A_KM, p * K.WGS84_B_KM)
    st, ct = F.sin(theta), F.cos(theta)
    lat = F.atan2(z + K.WGS84_EP2 * K.WGS84_B_KM * st * st * st, p - K.WGS84_E2 * K.WGS84_A_KM * ct * ct * ct)
    sl = F.sin(lat)
    alt = p / F.cos(lat) - K.WGS84_A_KM / F.sqrt(1 - K.WGS84_E2 * sl * sl)
    there = (p != 0) | (z != 0)
    return {"lat_deg": F.when(there, F.degrees(lat)), "lon_deg": F.when(there, wrap_longitude(F.degrees(F.atan2(y, x)))), "alt_km": F.when(there, alt)}


def look(sat: Vector, lat: Column, lon: Column, alt_km: Column | float = 0.0) -> dict[str, Column]:
    """Range, elevation, azimuth and line of sight from a ground point to a satellite in the Earth-fixed frame."""
    r = sub(sat, geodetic_to_ecef(lat, lon, alt_km))
    a, o = F.radians(lat), F.radians(lon)
    distance = norm(r)
    east = -F.sin(o) * r[0] + F.cos(o) * r[1]
    north = -F.sin(a) * F.cos(o) * r[0] - F.sin(a) * F.sin(o) * r[1] + F.cos(a) * r[2]
    up = F.cos(a) * F.cos(o) * r[0] + F.cos(a) * F.sin(o) * r[1] + F.sin(a) * r[2]
    ratio = F.least(F.greatest(F.try_divide(up, distance), F.lit(-1.0)), F.lit(1.0))
    elevation = F.when(distance > 0, F.degrees(F.asin(ratio))).otherwise(-90.0)
    return {"range_km": distance, "elevation_deg": elevation, "azimuth_deg": (F.degrees(F.atan2(east, north)) + 360.0) % 360.0, "line_of_sight": elevation > 0}


def mercator(lon: Column, lat: Column, width: float, height: float) -> tuple[Column, Column]:
    at = F.radians(F.least(F.greatest(lat, F.lit(-K.WEB_MERCATOR_MAX_LAT_DEG)), F.lit(K.WEB_MERCATOR_MAX_LAT_DEG)))
    return (wrap_longitude(lon) + 180.0) / 360.0 * width, height / 2 - width * F.log(F.tan(math.pi / 4 + at / 2)) / (2 * math.pi)


def mercator_inverse(x: Column, y: Column, width: float, height: float) -> tuple[Column, Column]:
    lat = F.degrees(2 * F.atan(F.exp((height / 2 - y) * (2 * math.pi) / width)) - math.pi / 2)
    return wrap_longitude(x / width * 360.0 - 180.0), F.least(F.greatest(lat, F.lit(-K.WEB_MERCATOR_MAX_LAT_DEG)), F.lit(K.WEB_MERCATOR_MAX_LAT_DEG))


def radial_velocity_mps(now_km: Column, later_km: Column, seconds: Column | float) -> Column:
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.when(s > 0, (later_km - now_km) * 1000.0 / s)


def surface_separation(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = (F.radians(F.least(F.greatest(x, F.lit(-90.0)), F.lit(90.0))) for x in (lat1, lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(wrap_longitude(lon2 - lon1)) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), h)))))


def beam_loss_db(separation: Column, half_power: Column | float, most: float = 45.0) -> Column:
    b = half_power if isinstance(half_power, Column) else F.lit(half_power)
    return F.when(separation.isNull() | (separation <= 0), 0.0).when(b.isNull() | (b <= 0), max(0.0, most)).otherwise(F.least(F.lit(max(0.0, most)), 3.0 * F.pow(F.try_divide(separation, b), 2)))


def array_beamwidth_deg(nx: Column, ny: Column, spacing: Column, element: float = 0.5, factor: float = 58.0, least: float = 0.35, most: float = 120.0) -> Column:
    def aperture(n: Column) -> Column:
        n = F.greatest(F.floor(F.coalesce(n, F.lit(0)) + 0.5), F.lit(0))
        return F.when(n <= 0, 0.0).when(n == 1, max(element, 0.1)).otherwise((n - 1) * F.greatest(F.coalesce(spacing, F.lit(0.0)), F.lit(0.0)) + element)

    wide = F.greatest(aperture(nx), aperture(ny))
    return F.when(wide <= 0, 120.0).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), F.try_divide(F.lit(factor), wide))))


def footprint_radius(distance_km: Column, radius_km: float = K.EARTH_RADIUS_KM) -> Column:
    """Angular radius of what is seen from a distance to the Earth's centre; null inside the Earth."""
    return F.when(distance_km > radius_km, F.acos(F.lit(radius_km) / distance_km))


def great_circle_point(lat: Column, lon: Column, radius: Column, bearing: Column) -> tuple[Column, Column]:
    """The point (degrees) at an angular radius and bearing (radians) from a centre (degrees)."""
    a = F.radians(lat)
    out = F.asin(F.least(F.greatest(F.sin(a) * F.cos(radius) + F.cos(a) * F.sin(radius) * F.cos(bearing), F.lit(-1.0)), F.lit(1.0)))
    turn = F.atan2(F.sin(bearing) * F.sin(radius) * F.cos(a), F.cos(radius) - F.sin(a) * F.sin(out))
    return F.degrees(out), wrap_longitude(lon + F.degrees(turn))


def julian_day(millis: Column) -> Column:
    return millis / F.lit(float(K.MS_DAY)) + K.UNIX_EPOCH_JD


def gmst(jd: Column) -> Column:
    d = jd - K.J2000_JD
    t = d / 36525.0
    degrees = 280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0
    return F.radians((degrees % 360.0 + 360.0) % 360.0)


def sun_direction(jd: Column) -> Vector:
    """Unit vector to the Sun by the low-precision series."""
    n = jd - K.J2000_JD
    mean, anomaly = F.radians((280.460 + 0.9856474 * n) % 360.0), F.radians((357.528 + 0.9856003 * n) % 360.0)
    lon = mean + F.radians(F.lit(1.915)) * F.sin(anomaly) + F.radians(F.lit(0.020)) * F.sin(2 * anomaly)
    tilt = F.radians(23.439 - 0.0000004 * n)
    return F.cos(lon), F.cos(tilt) * F.sin(lon), F.sin(tilt) * F.sin(lon)


def right_ascension(ra_deg: Column | None, ra_hours: Column) -> Column:
    ra = ra_hours * 15.0 if ra_deg is None else F.coalesce(ra_deg, ra_hours * 15.0)
    return (ra % 360.0 + 360.0) % 360.0


def sky_vector(ra: Column, dec: Column, radius: float = 1.0) -> Vector:
    a, d = F.radians(ra), F.radians(dec)
    return radius * F.cos(d) * F.cos(a), radius * F.cos(d) * F.sin(a), radius * F.sin(d)


def kepler(mean: Column, e: Column | float) -> Column:
    """Eight Newton steps from the mean anomaly, without a test of convergence."""
    e = e if isinstance(e, Column) else F.lit(e)
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), mean.cast("double"), lambda x, _: x - (x - e * F.sin(x) - mean) / (1 - e * F.cos(x)))


def true_anomaly(eccentric: Column, e: Column | float) -> Column:
    e = e if isinstance(e, Column) else F.lit(e)
    return 2 * F.atan2(F.sqrt(1 + e) * F.sin(eccentric / 2), F.sqrt(1 - e) * F.cos(eccentric / 2))


def inclined_ellipse(axis: Column | float, e: Column | float, inclination_deg: Column | float, nu: Column) -> Vector:
    """Position for a true anomaly; the second axis is up."""
    a, e, i = (x if isinstance(x, Column) else F.lit(x) for x in (axis, e, inclination_deg))
    r = a * (1 - e * e) / (1 + e * F.cos(nu))
    return r * F.cos(nu), r * F.sin(nu) * F.sin(F.radians(i)), r * F.sin(nu) * F.cos(F.radians(i))


def orbital_frame(r: Vector, v: Vector) -> dict[str, Vector]:
    """z to the centre, x along the velocity without its radial part, y = z × x; null when degenerate."""
    z = tuple(-c for c in unit(r))
    x = unit(sub(v, tuple(dot(v, z) * c for c in z)))
    y = unit(cross(z, x))
    return {"x": cross(y, z), "y": y, "z": z}


def occluded(point: Vector, eye: Vector, radius: float) -> Column:
    """Whether a sphere at the origin cuts the open segment from the eye to the point; a tangent doesn't."""
    d = sub(point, eye)
    a, b, c = dot(d, d), 2 * dot(eye, d), dot(eye, eye) - radius * radius
    disc = b * b - 4 * a * c
    near, far = F.try_divide(-b - F.sqrt(disc), 2 * a), F.try_divide(-b + F.sqrt(disc), 2 * a)
    return F.coalesce((disc > 0) & (((near > 0) & (near < 1)) | ((far > 0) & (far < 1))), F.lit(False))


def line_array_factor(psi: Column, n: int) -> Column:
    """Magnitude of a uniform line array's factor, 1 at the peak."""
    s = F.sin(psi / 2)
    return F.when(F.abs(s) < 1e-9, 1.0).otherwise(F.abs(F.try_divide(F.sin(n * psi / 2), n * s)))
