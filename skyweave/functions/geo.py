"""Geodesy on columns and on arrays: geodetic, ECEF and local east-north-up coordinates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 semi-major axis in metres and first eccentricity squared.
WGS84_A = 6378137.0
WGS84_E2 = 6.69437999014e-3

#: The meridian is nowhere curved more than with this radius, so a chord of r metres spans at most
#: 2 asin(r / (2 * SMALLEST_RADIUS)) of latitude.
SMALLEST_RADIUS = WGS84_A * (1 - WGS84_E2)


def ecef(lat: Column, lon: Column, height: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of degrees and metres, as three columns."""
    h = F.lit(height) if isinstance(height, (int, float)) else height
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(WGS84_E2) * F.pow(F.sin(phi), F.lit(2.0)))
    across = (n + h) * F.cos(phi)
    return across * F.cos(lam), across * F.sin(lam), (n * (1 - WGS84_E2) + h) * F.sin(phi)


def ecef_array(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Earth-centred coordinates at height 0, one row per point."""
    phi, lam = np.radians(lat), np.radians(lon)
    n = WGS84_A / np.sqrt(1 - WGS84_E2 * np.sin(phi) ** 2)
    return np.column_stack([n * np.cos(phi) * np.cos(lam), n * np.cos(phi) * np.sin(lam), n * (1 - WGS84_E2) * np.sin(phi)])


def enu(lat: Column, lon: Column, height: Column, lat0: Column, lon0: Column, height0: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a point as seen from the origin (lat0, lon0, height0)."""
    here, origin = ecef(lat, lon, height), ecef(lat0, lon0, height0)
    dx, dy, dz = (a - b for a, b in zip(here, origin, strict=True))
    sp, cp, sl, cl = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    east = cl * dy - sl * dx
    outward = cl * dx + sl * dy
    return east, cp * dz - sp * outward, cp * outward + sp * dz


def latitude_reach(radius_m: float) -> float:
    """Degrees of latitude that two points at most ``radius_m`` apart can differ, rounded up a little."""
    return float(np.degrees(2 * np.arcsin(min(1.0, radius_m / (2 * SMALLEST_RADIUS))))) * (1 + 1e-9) + 1e-12


def longitude_reach(lat: np.ndarray, radius_m: float) -> np.ndarray:
    """Degrees of longitude that a point within ``radius_m`` of one at ``lat`` can differ; 180 near the poles.

    The partner may lie closer to the pole by the latitude reach, where a degree is shorter.
    """
    worst = np.radians(np.minimum(np.abs(lat) + latitude_reach(radius_m), 90.0))
    axis = WGS84_A / np.sqrt(1 - WGS84_E2 * np.sin(worst) ** 2) * np.cos(worst)
    ratio = np.where(2 * axis > radius_m, radius_m / np.maximum(2 * axis, 1e-9), 1.0)
    return np.where(ratio < 1.0, np.degrees(2 * np.arcsin(np.minimum(ratio, 1.0))) * (1 + 1e-9) + 1e-12, 180.0)


def noise(key: Column, sigma: float, seed: int) -> Column:
    """Normal noise that depends on a key and a seed alone, so that it is the same however the rows are spread (Box and Muller)."""
    part = lambda k: (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(1 << 52)).cast("double") + 1) / float(1 << 52)
    return F.lit(sigma) * F.sqrt(-2 * F.log(part(0))) * F.cos(2 * np.pi * part(1))
