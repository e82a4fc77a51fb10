"""Transverse Mercator as column expressions: WGS 84 longitude and latitude to and from UTM metres.

Kruger's series in the third flattening n (Karney 2011, to n^4): errors are far below a millimetre within a zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and the UTM grid.
A, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0

N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# The series' published coefficients.
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
DELTA = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone; null outside the globe."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    return F.when(lon.between(-180, 180) & lat.between(-90, 90), zone + F.when(lat >= 0, 32600).otherwise(32700)).cast("long")


def to_utm(lon: Column, lat: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return SCALE * RADIUS * x + EAST, SCALE * RADIUS * y + (F.when(south, SOUTH).otherwise(0.0) if south is not None else F.lit(0.0))


def from_utm(east: Column, north: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Longitude and latitude."""
    xi = (north - (F.when(south, SOUTH).otherwise(0.0) if south is not None else F.lit(0.0))) / (SCALE * RADIUS)
    eta = (east - EAST) / (SCALE * RADIUS)
    a, b = xi, eta
    for j, k in enumerate(BETA, 1):
        a = a - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, k in enumerate(DELTA, 1):
        phi = phi + k * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(phi)


def bounds_wgs84(spark, left: float, bottom: float, right: float, top: float, zone: int, margin: float = 0.0) -> tuple[float, float, float, float]:
    """Longitudes and latitudes that hold a box of UTM metres, from points along its border."""
    from ..operators.vector import densify

    box = densify((float(left - margin), float(bottom - margin)), (float(right + margin), float(top + margin)))
    points = spark.createDataFrame(box, "x double, y double")
    lon, lat = from_utm(F.col("x"), F.col("y"), F.lit(zone))
    r = points.select(lon.alias("lon"), lat.alias("lat")).agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    return tuple(r)


def resolve_zone(rings: list[list[tuple[float, float]]]) -> int:
    """The UTM zone of a polygon's centroid, taken in an equal-area projection (x = lon, y = sin lat)."""
    a = cx = 0.0
    for ring in rings:
        flat = [(math.radians(x), math.sin(math.radians(y))) for x, y in ring]
        for (x1, y1), (x2, y2) in zip(flat, flat[1:] + flat[:1], strict=True):
            c = x1 * y2 - x2 * y1
            a += c
            cx += (x1 + x2) * c
    return min(int((math.degrees(cx / (3 * a)) + 180) // 6) + 1, 60)
