"""Decibels, angles, and ship geometry on a locally flat earth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hydrophone and shipping-lane points (degrees), earth radius (m),
# in-range limit (m), metres per second in a knot, slowest speed used (knots).
HYDRO_LAT = 48 + 33.5013 / 60.0
HYDRO_LON = -(123 + 10.4046 / 60.0)
LANE_LAT = 48 + 33.49 / 60.0
LANE_LON = -(123 + 12.388 / 60.0)
EARTH_M = 6371000
RANGE_LIMIT_M = 10000
KNOT_MS = 0.514
MIN_KNOTS = 0.01


def db(x: Column, cal: float | Column = 0.0) -> Column:
    """``10 log10 x`` plus a calibration offset; NULL where x is not positive."""
    offset = cal if isinstance(cal, Column) else F.lit(float(cal))
    return F.when(x > 0, 10 * F.log10(x) + offset)


def safediv(x: Column, y: Column) -> Column:
    return F.when(y == 0, x).otherwise(F.try_divide(x, y))


def wrap360(x: Column) -> Column:
    """Degrees above 360 less a full turn."""
    return F.when(x > 360, x - 360).otherwise(x)


def _north_m(lat: Column, lat0: float) -> Column:
    return EARTH_M * F.radians(lat - lat0)


def _east_m(lat: Column, lon: Column, lon0: float) -> Column:
    return EARTH_M * F.radians(lon - lon0) * F.cos(F.radians(lat))


def range_m(lat: Column, lon: Column, lat0: float = HYDRO_LAT, lon0: float = HYDRO_LON) -> Column:
    return F.hypot(_north_m(lat, lat0), _east_m(lat, lon, lon0))


def bearing_deg(lat: Column, lon: Column, lat0: float = HYDRO_LAT, lon0: float = HYDRO_LON) -> Column:
    """Bearing of the ship seen from the fixed point, 0 to 360."""
    deg = F.degrees(F.atan2(_east_m(lat, lon, lon0), _north_m(lat, lat0)))
    return F.when(deg < 0, deg + 360).otherwise(deg)


def lane_minutes(lat: Column, lon: Column, sog: Column, cog: Column) -> Column:
    """Minutes between ship and lane point, negative once it has passed."""
    minutes = range_m(lat, lon, LANE_LAT, LANE_LON) / (F.greatest(sog, F.lit(MIN_KNOTS)) * KNOT_MS * 60)
    southbound = (cog > 90) & (cog < 270)
    northbound = (cog > 270) | (cog < 90)
    passed = ((lat < LANE_LAT) & southbound) | ((lat > LANE_LAT) & northbound)
    return F.when(F.coalesce(passed, F.lit(False)), -minutes).otherwise(minutes)


def pitch_scale(semitones: Column) -> Column:
    """Frequency ratio of a shift in semitones."""
    return F.pow(F.lit(2.0), semitones / 12)
