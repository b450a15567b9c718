"""Geographic column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: mean Earth radius and length of a degree used throughout
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32
# fixed values: WGS84 ellipsoid and the UTM scale
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING = 10000000.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dphi = F.radians(lat2 - lat1) / 2
    dlam = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dphi), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlam), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bbox_around(lat: Column, lon: Column, km: float) -> Column:
    dlat = F.lit(km / KM_PER_DEGREE)
    dlon = F.lit(float(km)) / (KM_PER_DEGREE * F.cos(F.radians(lat)))
    return F.struct(
        (lat - dlat).alias("south"), (lat + dlat).alias("north"), (lon - dlon).alias("west"), (lon + dlon).alias("east")
    )


def region_bbox(lat: float, lon: float, km: float) -> dict[str, float]:
    """The same box for one fixed centre, as plain numbers."""
    dlat, dlon = km / KM_PER_DEGREE, km / (KM_PER_DEGREE * math.cos(math.radians(lat)))
    return {"south": lat - dlat, "north": lat + dlat, "west": lon - dlon, "east": lon + dlon}


def bbox_area_km2(south: Column, north: Column, west: Column, east: Column) -> Column:
    band = F.sin(F.radians(north)) - F.sin(F.radians(south))
    return EARTH_RADIUS_KM**2 * F.radians(east - west) * band


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_direction(u: Column, v: Column) -> Column:
    angle = F.degrees(F.atan2(u, v))
    return F.when((u == 0) & (v == 0), F.lit(0.0)).when(angle < 0, angle + 360).otherwise(angle)


def normalize_lon(lon: Column) -> Column:
    wrapped = F.pmod(lon + 180, F.lit(360.0)) - 180
    return (
        F.when(F.abs(lon) <= 180, lon).when((lon > 180) & (wrapped == -180), F.lit(180.0)).otherwise(wrapped)
    )


def valid_coords(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def in_bbox(lat: Column, lon: Column, bbox: dict[str, float]) -> Column:
    return lat.between(bbox["south"], bbox["north"]) & lon.between(bbox["west"], bbox["east"])


def utm_zone(lon: Column) -> Column:
    return ((lon + 180) / 6).cast("int") + 1


def utm_epsg(zone: Column, northern: Column) -> Column:
    return F.when(northern, zone + 32600).otherwise(zone + 32700)


def _series(n: float, rows: list[list[float]]) -> list[float]:
    return [sum(c * n**p for p, c in enumerate(row, start=i + 1)) for i, row in enumerate(rows)]


_N = WGS84_F / (2 - WGS84_F)
_RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# fixed values: coefficients of the published transverse Mercator series, in powers of the third flattening
_ALPHA = _series(
    _N,
    [
        [1 / 2, -2 / 3, 5 / 16, 41 / 180],
        [13 / 48, -3 / 5, 557 / 1440],
        [61 / 240, -103 / 140],
        [49561 / 161280],
    ],
)
_BETA = _series(
    _N,
    [
        [1 / 2, -2 / 3, 37 / 96, -1 / 360],
        [1 / 48, 1 / 15, -437 / 1440],
        [17 / 480, -37 / 840],
        [4397 / 161280],
    ],
)
_DELTA = _series(
    _N,
    [
        [2, -2 / 3, -2, 116 / 45],
        [7 / 3, -8 / 5, -227 / 45],
        [56 / 15, -136 / 35],
        [4279 / 630],
    ],
)


def _central_meridian(zone: Column) -> Column:
    return (zone * 6 - 183).cast("double")


def to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    s, dlam = F.sin(F.radians(lat)), F.radians(lon - _central_meridian(zone))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dlam)), F.atanh(F.sin(dlam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = UTM_SCALE * _RECTIFYING
    return FALSE_EASTING + k * east, F.when(lat < 0, FALSE_NORTHING).otherwise(0.0) + k * north


def from_utm(easting: Column, northing: Column, zone: Column, northern: bool = True) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    k = UTM_SCALE * _RECTIFYING
    xi = (northing - (0.0 if northern else FALSE_NORTHING)) / k
    eta = (easting - FALSE_EASTING) / k
    xp, ep = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xp = xp - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    lat = chi
    for j, d in enumerate(_DELTA, start=1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), _central_meridian(zone) + F.degrees(F.atan2(F.sinh(ep), F.cos(xp)))
