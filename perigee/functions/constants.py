"""Fixed values that results depend on, in natural order."""

# Physical constants.
EARTH_RADIUS_KM = 6378.137
EARTH_MU_KM3_S2 = 398600.4418
#: Used for the acceleration bound of screening only; it differs from the one above.
SCREENING_MU_KM3_S2 = 398600.8
WGS84_A_KM, WGS84_F = 6378.137, 1 / 298.257223563
WGS84_B_KM = WGS84_A_KM * (1 - WGS84_F)
WGS84_E2 = WGS84_F * (2 - WGS84_F)
WGS84_EP2 = (WGS84_A_KM**2 - WGS84_B_KM**2) / WGS84_B_KM**2
WEB_MERCATOR_MAX_LAT_DEG = 85.05112878
SPEED_OF_LIGHT_MPS = 299792458.0
BOLTZMANN_W_PER_HZ_K = 1.380649e-23
MINUTES_PER_DAY, MS_DAY = 1440.0, 86_400_000
J2000_JD, UNIX_EPOCH_JD = 2451545.0, 2440587.5

# The closed vocabularies.
OBJECT_TYPES = ("PAYLOAD", "ROCKET_BODY", "DEBRIS", "UNKNOWN")
ORBIT_CLASSES = ("LEO", "MEO", "GEO", "HEO", "DECAYING", "OTHER", "UNKNOWN")
LIFECYCLES = ("ACTIVE", "INACTIVE", "DECAYED", "RETIRED", "UNKNOWN")
FRAMES = ("TEME", "GCRF", "ITRF", "RTN", "ENCOUNTER_PLANE")
TIME_SCALES = ("UTC", "TAI", "UT1")
TRANSITIONS = ("NEW", "UNCHANGED", "UPDATED", "ABSENT", "REAPPEARED", "DECAYED", "RETIRED")
SOURCE_FORMATS = ("TLE", "OMM_JSON", "OMM_KVN", "OEM_KVN", "PROVIDER_EPHEMERIS_JSON")

# Days after which an element set of an orbit class is stale.
MAX_AGE_DAYS = {"LEO": 7, "MEO": 14, "GEO": 14, "HEO": 7, "DECAYING": 1, "OTHER": 7, "UNKNOWN": 7}
FUTURE_TOLERANCE_DAYS = 0.01

# Spellings of object types and lifecycle states.
TYPE_SPELLINGS = {
    "PAYLOAD": ("PAY", "PAYLOAD", "SAT", "SATELLITE"),
    "ROCKET_BODY": ("R/B", "RB", "ROCKET_BODY", "ROCKETBODY"),
    "DEBRIS": ("DEB", "DEBRIS", "FRAGMENT", "FRAGMENTATION_DEBRIS"),
}
LIFECYCLE_SPELLINGS = {
    "ACTIVE": ("ACTIVE", "OPERATIONAL"),
    "INACTIVE": ("INACTIVE", "NONOPERATIONAL", "NON_OPERATIONAL"),
    "DECAYED": ("DECAYED", "REENTERED", "RE_ENTERED"),
    "RETIRED": ("RETIRED", "REMOVED"),
}
NO_DATA = "no data"

# Prefixes of identities by scheme.
ID_SCHEME = "obx:"
NORAD_SCHEME, COSPAR_SCHEME, PROVIDER_SCHEME = ID_SCHEME + "norad:", ID_SCHEME + "cospar:", ID_SCHEME + "provider:"

# Screening jobs.
JOB_STATES = ("QUEUED", "RUNNING", "CANCEL_REQUESTED", "SUCCEEDED", "FAILED", "CANCELLED", "TIMED_OUT")
TERMINAL_STATES = ("SUCCEEDED", "FAILED", "CANCELLED", "TIMED_OUT")
