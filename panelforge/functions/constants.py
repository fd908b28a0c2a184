"""Fixed values of the domain."""

from __future__ import annotations

#: Sensors in their fixed order; codes are positions.
SENSORS = ("T", "A", "N", "J1", "J2")
REFERENCE_SENSOR = 1
SATELLITES = {"Terra": True, "NOAA-21": False, "NOAA-20": False, "S-NPP": True, "Aqua": True}  # name: retiring
PERIODS = 46
MIN_COVERAGE, RATE_FLOOR, MIN_LAND = 0.30, 0.01, 100.0
Q_MIN, P_SURE, P_MAYBE, MIN_BASELINE_N = 0.5, 0.90, 0.60, 20
Z80, Z95 = 1.2815515655446004, 1.959963984540054
STATIC_GRID, STATIC_DETECTIONS, STATIC_DAYS, STATIC_MONTHS, STATIC_YEARS = 0.0036, 5, 5, 3, 2
STATIC_TRAIN = (2012, 2022)
DEDUPE_KM, KM_PER_DEGREE, EARTH_KM = 0.2, 111.32, 6371.0
#: WGS 84.
ELLIPSOID_M, FLATTENING = 6378137.0, 1 / 298.257223563
SPHERE_M, TILE_M, TILE_PIXELS = 6371007.181, 1111950.5197665233, 1200
CHAINS = {"T": ("T", "A"), "A": ("A",), "N": ("N", "A"), "J1": ("J1", "N", "A"), "J2": ("J2", "J1", "N", "A")}
NOT_ACTIVE, NOT_OBSERVED, LOW, MAYBE_LOW, TYPICAL, MAYBE_HIGH, HIGH, RECORD, INSUFFICIENT, PENDING = range(-1, 9)
FLAG_PROVISIONAL, FLAG_HELD_OUT, FLAG_CALIBRATION, FLAG_PARTIAL, FLAG_PENDING, FLAG_PROXY = 1, 2, 4, 8, 16, 32
#: Satellite names that imports may use, in capitals.
ALIASES = {
    "T": "Terra", "TERRA": "Terra", "A": "Aqua", "AQUA": "Aqua", "N": "S-NPP", "NPP": "S-NPP", "SUOMI NPP": "S-NPP", "S-NPP": "S-NPP",
    "NOAA-20": "NOAA-20", "NOAA20": "NOAA-20", "N20": "NOAA-20", "J1": "NOAA-20", "NOAA-21": "NOAA-21", "NOAA21": "NOAA-21", "N21": "NOAA-21", "J2": "NOAA-21",
}
#: Hart's rational approximation of the normal distribution function, as published by West (2005).
NORMAL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
NORMAL_SWITCH, NORMAL_ROOT = 7.07106781186547, 2.506628274631
