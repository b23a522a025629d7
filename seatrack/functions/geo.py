"""Scalar expressions that operators share, as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
EARTH_RADIUS_M = 6_371_000.0
KNOT_MPS = 0.514444
VESSEL_CAP_MPS = 25 * KNOT_MPS
CAPS_MPS = {"vessel": VESSEL_CAP_MPS, "vehicle": 130 / 3.6, "pedestrian": 2.0, "uav": 30.0}
EPS = 1e-6


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x held to [low, high]; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def bound(x: Column, f) -> Column:
    """f(x), where x is computed once for a row however often f names it. As a plain column x is copied to each place, also into filters that move below it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in metres, clamped for antipodes."""
    half_lat, half_lon = (F.radians(lat_b) - F.radians(lat_a)) / 2, F.radians(lon_b - lon_a) / 2
    s = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def wrap_rad(x: Column) -> Column:
    return F.when(F.abs(x) <= math.pi, x).otherwise(F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi)


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from timestamp a to timestamp b, with microseconds."""
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def to_local_xy(lat: Column, lon: Column, lat_ref: Column, lon_ref: Column) -> tuple[Column, Column]:
    """Azimuthal-equidistant coordinates in metres about a reference in radians; null near the antipode."""
    phi, delta = F.radians(lat), wrap_rad(F.radians(lon) - lon_ref)
    half = F.pow(F.sin((phi - lat_ref) / 2), 2) + F.cos(lat_ref) * F.cos(phi) * F.pow(F.sin(delta / 2), 2)
    c = 2 * F.asin(F.sqrt(clip(half)))
    k = F.when(c == 0, F.lit(1.0)).when(c < math.pi - 1e-9, c / F.sin(c))
    x = EARTH_RADIUS_M * k * F.cos(phi) * F.sin(delta)
    y = EARTH_RADIUS_M * k * (F.cos(lat_ref) * F.sin(phi) - F.sin(lat_ref) * F.cos(phi) * F.cos(delta))
    return x, y


def to_lon_lat(x: Column, y: Column, lat_ref: Column, lon_ref: Column) -> tuple[Column, Column]:
    """Inverse of to_local_xy in degrees; the longitude is continuous about the reference."""
    c = F.hypot(x, y) / EARTH_RADIUS_M
    toward = F.atan2(x, y)
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(lat_ref) * F.cos(c) + F.cos(lat_ref) * F.sin(c) * F.cos(toward))))
    delta = F.atan2(F.sin(toward) * F.sin(c) * F.cos(lat_ref), F.cos(c) - F.sin(lat_ref) * F.sin(lat))
    return F.degrees(lon_ref + delta), F.degrees(lat)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment in the plane."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, clip(((px - ax) * dx + (py - ay) * dy) / F.when(length > 0, length).otherwise(1.0))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def noisy_or(severities: Column) -> Column:
    """1 minus the product of (1 - s) over an array of severities."""
    return 1.0 - F.aggregate(severities, F.lit(1.0), lambda acc, s: acc * (1.0 - clip(s)))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def kolmogorov_sf(lam: Column) -> Column:
    """Survival function of the Kolmogorov distribution: the series that converges fast on either side of 1."""
    small = F.aggregate(
        F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda acc, k: acc + F.exp(-F.pow(2.0 * k - 1.0, F.lit(2.0)) * (math.pi**2) / (8.0 * lam * lam))
    )
    large = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam)
    )
    return F.when(lam < 0.1, 1.0).when(lam < 1.0, clip(1.0 - math.sqrt(2 * math.pi) / lam * small)).otherwise(clip(2.0 * large))


def erf(x: Column) -> Column:
    """The error function to 1e-14: the series of rising factors up to 3, the continued fraction of the tail beyond. x should be a plain column, as it occurs in every term."""
    a = F.abs(x)
    series = F.lit(1.0)
    for n in reversed(range(1, 71)):
        series = 1.0 + 2.0 * a * a / (2.0 * n + 1.0) * series
    tail = a + 1.0
    for n in reversed(range(1, 61)):
        tail = a + n / 2.0 / tail
    bell = F.exp(-a * a) / math.sqrt(math.pi)
    return F.signum(x) * F.when(a < 3.0, 2.0 * a * bell * series).otherwise(1.0 - bell / tail)
