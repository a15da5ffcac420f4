"""Map projections as column expressions.

The South American geographic systems used by the inputs (EPSG:4326 and EPSG:4674) differ by less than a
metre and are treated as the same; the change between them is the identity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS 1980 ellipsoid and the parameters of EPSG:5880 (polyconic, origin 0 N 54 W).
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
CENTRAL_MERIDIAN = -54.0
FALSE_EASTING = 5_000_000.0
FALSE_NORTHING = 10_000_000.0

# Fixed value: sphere radius of EPSG:3857.
MERCATOR_RADIUS = 6378137.0

_E2 = FLATTENING * (2 - FLATTENING)
# Meridian-arc series (Snyder 1987, eq. 3-21).
_M0 = 1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256
_M2 = 3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024
_M4 = 15 * _E2**2 / 256 + 45 * _E2**3 / 1024
_M6 = 35 * _E2**3 / 3072


def wrapped_longitude(lon: Column) -> Column:
    """Degrees east of the central meridian, in [-180, 180)."""
    offset = lon - CENTRAL_MERIDIAN
    return offset - F.floor((offset + 180.0) / 360.0) * 360.0


def polyconic_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:5880 metres (Snyder 1987, eq. 18-12 to 18-14)."""
    phi = F.radians(lat)
    lam = F.radians(wrapped_longitude(lon))
    sin_phi = F.sin(phi)
    normal = SEMI_MAJOR / F.sqrt(1 - _E2 * sin_phi * sin_phi)
    arc = SEMI_MAJOR * (_M0 * phi - _M2 * F.sin(2 * phi) + _M4 * F.sin(4 * phi) - _M6 * F.sin(6 * phi))
    angle = lam * sin_phi
    # the tangent is replaced on the equator only to keep the unused branch finite
    tangent = F.when(phi == 0, 1.0).otherwise(F.tan(phi))
    half = F.sin(angle / 2)
    east = F.when(phi == 0, SEMI_MAJOR * lam).otherwise(normal * F.sin(angle) / tangent)
    north = F.when(phi == 0, 0.0).otherwise(arc + 2 * normal * half * half / tangent)
    return east + FALSE_EASTING, north + FALSE_NORTHING


def mercator_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:3857 metres; meant for latitudes between -85 and 85."""
    x = MERCATOR_RADIUS * F.radians(lon)
    y = MERCATOR_RADIUS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    return x, y


def mercator_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 metres back to EPSG:4326 degrees."""
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(F.atan(F.sinh(y / MERCATOR_RADIUS)))
