"""Map projections, distances, tiles and boxes as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere of distances, sphere of web Mercator, WGS84 flattening, UTM scale and false origin.
EARTH_M, MERCATOR_M = 6_371_000.0, 6_378_137.0
FLATTENING, UTM_SCALE, UTM_EASTING = 1 / 298.257223563, 0.9996, 500_000.0
TILE_DEG = 0.005


def mercator_scale_factor(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def ground_scale_factor(mode: Column, lat: Column, reference_lat: Column) -> Column:
    """True metres per projected metre: cos of the latitude under web Mercator, else 1."""
    return F.when(mode == "WEB_MERCATOR", mercator_scale_factor(F.coalesce(lat, reference_lat, F.lit(0.0)))).otherwise(F.lit(1.0))


def utm_zone(lon: Column) -> Column:
    return ((lon + 180.0) / 6.0).cast("int") + 1


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * MERCATOR_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_M


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR_M)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / MERCATOR_M)) * 2 - math.pi / 2)


def _series() -> tuple[float, list[float], list[float]]:
    """Radius of the rectifying sphere and the coefficients of the transverse Mercator series, to n cubed."""
    n = FLATTENING / (2 - FLATTENING)
    radius = MERCATOR_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, forward, back


def _total(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def utm_xy(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing; without a false northing in the south."""
    radius, alpha, _ = _series()
    e = 2 * math.sqrt(FLATTENING / (2 - FLATTENING)) / (1 + FLATTENING / (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * e) * e)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    x = eta + _total([F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * a for j, a in enumerate(alpha, 1)])
    y = xi + _total([F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * a for j, a in enumerate(alpha, 1)])
    return x * (UTM_SCALE * radius) + UTM_EASTING, y * (UTM_SCALE * radius)


def utm_latlon(x: Column, y: Column, zone: Column) -> tuple[Column, Column]:
    radius, _, beta = _series()
    n = FLATTENING / (2 - FLATTENING)
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi, eta = y / (UTM_SCALE * radius), (x - UTM_EASTING) / (UTM_SCALE * radius)
    xi1 = xi - _total([F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * b for j, b in enumerate(beta, 1)])
    eta1 = eta - _total([F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * b for j, b in enumerate(beta, 1)])
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + _total([F.sin(chi * 2 * j) * d for j, d in enumerate(delta, 1)])
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + (zone * 6 - 183)


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres, by atan2."""
    h = _half_chord(lat1, lon1, lat2, lon2)
    return F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h))) * (2 * EARTH_M)


def haversine_asin(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres, by asin; the form of the run comparison."""
    return F.asin(F.least(F.lit(1.0), F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))) * (2 * EARTH_M)


def wrap_deg(d: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(d + 180.0, F.lit(360.0)) - 180.0


def tile(coordinate: Column, deg: float = TILE_DEG) -> Column:
    """Tile number; truncates toward zero, so tile 0 is twice as wide."""
    return (coordinate / deg).cast("int")


def in_bounds(lat: Column, lon: Column, lat_min: Column, lon_min: Column, lat_max: Column, lon_max: Column) -> Column:
    """Inclusive; missing bounds contain every point."""
    unknown = lat_min.isNull() | lon_min.isNull() | lat_max.isNull() | lon_max.isNull()
    return unknown | (lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max))


def ground_sample_distance(altitude_m: Column, focal_mm: Column, sensor_mm: Column, width_px: Column) -> Column:
    """Metres per pixel; 0 where an input is not positive."""
    usable = (altitude_m > 0) & (focal_mm > 0) & (sensor_mm > 0) & (width_px > 0)
    return F.when(usable, F.try_divide(altitude_m * sensor_mm, focal_mm * width_px)).otherwise(F.lit(0.0))


def format_coordinates(lat: Column, lon: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f, %.{digits}f", lat, lon)


def quarter_turn(yaw_deg: Column) -> Column:
    """Nearest multiple of 90 degrees in [0, 360); halves go to the even multiple."""
    return (F.bround(F.pmod(yaw_deg, F.lit(360.0)) / 90.0, 0) * 90.0).cast("int") % 360
