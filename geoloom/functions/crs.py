"""Closed-form coordinate transforms as column expressions.

Supported codes: 4326 (longitude/latitude), 3857 (spherical Mercator) and the
UTM zones 32601-32660 and 32701-32760 (Krueger series on the WGS 84 ellipsoid).
Any other code raises.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geom import bbox, map_vertices

GEOGRAPHIC = 4326
MERCATOR = 3857

# WGS 84 ellipsoid and UTM constants.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_EASTING = 500000.0
UTM_SOUTH_NORTHING = 10000000.0

_N = WGS84_F / (2 - WGS84_F)
_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(WGS84_F * (2 - WGS84_F))
# Third-order Krueger coefficients (forward, inverse, latitude).
_ALPHA = (
    _N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3,
    13 / 48 * _N**2 - 3 / 5 * _N**3,
    61 / 240 * _N**3,
)
_BETA = (
    _N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3,
    1 / 48 * _N**2 + 1 / 15 * _N**3,
    17 / 480 * _N**3,
)
_DELTA = (
    2 * _N - 2 / 3 * _N**2 - 2 * _N**3,
    7 / 3 * _N**2 - 8 / 5 * _N**3,
    56 / 15 * _N**3,
)


def parse_code(crs) -> int:
    """``4326``, ``"4326"`` or ``"EPSG:4326"`` to a supported integer code."""
    text = str(crs).upper().removeprefix("EPSG:")
    if not text.isdigit() or not is_supported(int(text)):
        raise ValueError(f"unsupported CRS {crs!r}: use EPSG 4326, 3857, 32601-32660 or 32701-32760")
    return int(text)


def is_supported(code: int) -> bool:
    return code in (GEOGRAPHIC, MERCATOR) or is_utm(code)


def is_utm(code: int) -> bool:
    return 32601 <= code <= 32660 or 32701 <= code <= 32760


def utm_zone(lon: float, lat: float) -> int:
    """The UTM code of a position (a driver-side helper for a known centre)."""
    zone = min(max(int((lon + 180) // 6) + 1, 1), 60)
    return (32600 if lat >= 0 else 32700) + zone


def _utm_params(code: int) -> tuple[float, float]:
    zone = code % 100
    return math.radians(zone * 6 - 183), (UTM_SOUTH_NORTHING if code >= 32700 else 0.0)


def _asinh(v: Column) -> Column:
    return F.signum(v) * F.log(F.abs(v) + F.sqrt(v * v + 1))


def _atanh(v: Column) -> Column:
    return F.log((1 + v) / (1 - v)) / 2


def lonlat_to(code: int, x: Column, y: Column) -> tuple[Column, Column]:
    if code == GEOGRAPHIC:
        return x, y
    if code == MERCATOR:
        return (
            F.radians(x) * WGS84_A,
            F.log(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)) * WGS84_A,
        )
    lon0, south = _utm_params(code)
    phi, lam = F.radians(y), F.radians(x) - lon0
    s = F.sin(phi)
    t = F.sinh(_atanh(s) - F.lit(_E) * _atanh(s * _E))
    xi = F.atan2(t, F.cos(lam))
    eta = _atanh(F.sin(lam) / F.sqrt(t * t + 1))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_EASTING + UTM_K0 * _RADIUS * east, south + UTM_K0 * _RADIUS * north


def lonlat_from(code: int, x: Column, y: Column) -> tuple[Column, Column]:
    if code == GEOGRAPHIC:
        return x, y
    if code == MERCATOR:
        return F.degrees(x / WGS84_A), F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2)
    lon0, south = _utm_params(code)
    xi = (y - south) / (UTM_K0 * _RADIUS)
    eta = (x - UTM_EASTING) / (UTM_K0 * _RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.degrees(lam + lon0), F.degrees(phi)


def transform_xy(src: int, dst: int, x: Column, y: Column) -> tuple[Column, Column]:
    src, dst = parse_code(src), parse_code(dst)
    if src == dst:
        return x, y
    return lonlat_to(dst, *lonlat_from(src, x, y))


def transform_geom(g: Column, src: int, dst: int) -> Column:
    if parse_code(src) == parse_code(dst):
        return g
    return map_vertices(g, lambda x, y: transform_xy(src, dst, x, y))


def layer_srid(df: DataFrame, srid: int | None = None) -> int:
    """The single CRS code of a layer; a layer without one is refused.

    Pass ``srid`` to skip the look-up.  Otherwise one aggregate reads the lowest
    and the highest code, which must be equal.
    """
    if srid is not None:
        return parse_code(srid)
    if "srid" not in df.columns:
        raise ValueError("this layer has no CRS, so distance and area are meaningless for it")
    low, high = df.agg(F.min("srid"), F.max("srid")).first()
    if low is None:
        raise ValueError("this layer has no CRS, so distance and area are meaningless for it")
    if low != high:
        raise ValueError(f"this layer mixes CRS codes {low} and {high}")
    return parse_code(low)


def metric_srid(df: DataFrame, geom: str = "geom", srid: int | None = None) -> tuple[int, int]:
    """``(source code, metric code)``: UTM at the layer's centre for a geographic layer."""
    src = layer_srid(df, srid)
    if src != GEOGRAPHIC:
        return src, src
    b = bbox(F.col(geom))
    row = df.agg(F.min(b["minx"]), F.min(b["miny"]), F.max(b["maxx"]), F.max(b["maxy"])).first()
    if row[0] is None:
        return src, src
    return src, utm_zone((row[0] + row[2]) / 2, (row[1] + row[3]) / 2)
