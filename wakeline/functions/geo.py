"""Geometry and angles as Column expressions (distances in km, NM or metres)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
EARTH_M = 6371000.0
KM_PER_NM = 1.852
KNOTS_TO_MPS = 0.514444
M_PER_DEG = EARTH_M * 3.141592653589793 / 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    )
    # not least(): that would turn a missing coordinate into a distance
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) / KM_PER_NM


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlon = F.radians(lon2 - lon1)
    east = F.sin(dlon) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def speed_knots(distance_nm: Column, hours: Column, cap: float = 100.0) -> Column:
    """Implied speed; NULL for a non-positive duration or an absurd result."""
    speed = F.when(hours > 0, distance_nm / hours)
    return F.when(speed <= cap, speed)


def angle_delta(raw: Column) -> Column:
    """A difference of two courses folded to (-180, 180]."""
    return F.when(raw > 180, raw - 360).when(raw < -180, raw + 360).otherwise(raw)


def circular_error(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.least(gap, 360.0 - gap)


def velocity_east(speed_mps: Column, course: Column) -> Column:
    return speed_mps * F.cos(F.radians(90.0 - course))


def velocity_north(speed_mps: Column, course: Column) -> Column:
    return speed_mps * F.sin(F.radians(90.0 - course))


def knots_to_mps(knots: Column) -> Column:
    return knots * KNOTS_TO_MPS


def metres_per_lon_degree(ref_lat: Column) -> Column:
    return F.cos(F.radians(ref_lat)) * M_PER_DEG


def to_local(lat: Column, lon: Column, ref_lat: Column, ref_lon: Column) -> tuple[Column, Column]:
    """Equirectangular metres (east, north) around a reference point."""
    return (lon - ref_lon) * metres_per_lon_degree(ref_lat), (lat - ref_lat) * M_PER_DEG


def from_local(x: Column, y: Column, ref_lat: Column, ref_lon: Column) -> tuple[Column, Column]:
    """Inverse of :func:`to_local`: (lat, lon)."""
    return y / M_PER_DEG + ref_lat, x / metres_per_lon_degree(ref_lat) + ref_lon


def cap_speed(vx: Column, vy: Column, max_mps: float) -> tuple[Column, Column]:
    """Scale a velocity down to a speed limit, keeping its direction."""
    speed = F.sqrt(vx * vx + vy * vy)
    scale = F.when(speed > max_mps, max_mps / speed).otherwise(1.0)
    return vx * scale, vy * scale
