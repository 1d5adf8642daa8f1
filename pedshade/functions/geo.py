"""Distances, grids and projections as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pedshade.config import COORDINATE_SCALE, SAMPLER_EARTH_RADIUS_M, SNAP_EARTH_RADIUS_M, WATER_TIERS


def lit(x: float) -> Column:
    return F.lit(float(x))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = SNAP_EARTH_RADIUS_M) -> Column:
    """Great-circle metres; the square root is held at 1 before the arc sine."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return lit(2 * radius) * F.asin(F.least(lit(1), F.sqrt(a)))


def equirectangular(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = SAMPLER_EARTH_RADIUS_M) -> Column:
    """Metres on a plane that is true at the middle latitude."""
    x = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(x, lat2 - lat1) * lit(math.pi / 180 * radius)


def in_bbox(lon: Column, lat: Column, bbox: tuple[float, float, float, float]) -> Column:
    """Inclusive; null and NaN coordinates are outside."""
    west, south, east, north = bbox
    inside = lon.between(lit(west), lit(east)) & lat.between(lit(south), lit(north))
    return F.coalesce(inside, F.lit(False)) & ~F.coalesce(F.isnan(lon) | F.isnan(lat), F.lit(True))


def bbox_intersects(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Touching boxes intersect; boxes are (west, south, east, north)."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def valid_coordinate(lon: Column, lat: Column) -> Column:
    return in_bbox(lon, lat, (-180.0, -90.0, 180.0, 90.0))


def water_penalty(distance: Column) -> Column:
    """Penalty of a tier; an error for negative or NaN distances, null for null."""
    bad = (distance < 0) | F.isnan(distance)
    expr = F.when(bad, F.raise_error(F.lit("water distance must not be negative or NaN")).cast("double"))
    for upper, penalty in WATER_TIERS:
        expr = expr.when(distance <= lit(upper), lit(penalty))
    return expr.when(distance.isNotNull(), lit(1))


def quantize(x: Column) -> Column:
    """Fixed point at 1e-7, halves toward plus infinity."""
    return F.floor(x * lit(COORDINATE_SCALE) + lit(0.5)).cast("long")


def dequantize(q: Column) -> Column:
    return q.cast("double") / lit(COORDINATE_SCALE)


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + lit(180)) / lit(360) * F.pow(lit(2), zoom)).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    r = F.radians(lat)
    mercator = F.log(F.tan(r) + lit(1) / F.cos(r))
    return F.floor((lit(1) - mercator / lit(math.pi)) / lit(2) * F.pow(lit(2), zoom)).cast("long")


def tiles_of(west: Column, south: Column, east: Column, north: Column, zoom: int) -> Column:
    """Array of the (x, y) tiles that a box meets at one zoom; y grows south."""
    z = F.lit(zoom)
    xs = F.sequence(tile_x(west, z), tile_x(east, z))
    ys = F.sequence(tile_y(north, z), tile_y(south, z))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def mesh_id(lon: Column, lat: Column) -> Column:
    """Eight-digit code of the third-order grid square that holds a point."""
    first_lat = F.floor(lat * lit(1.5))
    first_lon = F.floor(lon) - F.lit(100)
    lat_minutes = lat * lit(60) - first_lat * lit(40)
    lon_minutes = (lon - lit(100) - first_lon) * lit(60)
    second_lat, second_lon = F.floor(lat_minutes / lit(5)), F.floor(lon_minutes / lit(7.5))
    third_lat = F.floor((lat_minutes - second_lat * lit(5)) / lit(0.5))
    third_lon = F.floor((lon_minutes - second_lon * lit(7.5)) / lit(0.75))
    two = [F.lpad(x.cast("string"), 2, "0") for x in (first_lat, first_lon)]
    return F.concat(*two, *[x.cast("string") for x in (second_lat, second_lon, third_lat, third_lon)])


def mesh_bounds(mesh: Column) -> Column:
    """Struct (west, south, east, north); null for what is no eight-digit code."""
    d = lambda at, n=1: F.substring(mesh, at, n).cast("double")
    south = d(1, 2) / lit(1.5) + d(5) * lit(5 / 60) + d(7) * lit(30 / 3600)
    west = lit(100) + d(3, 2) + d(6) * lit(7.5 / 60) + d(8) * lit(45 / 3600)
    box = F.struct(
        west.alias("west"), south.alias("south"), (west + lit(45 / 3600)).alias("east"), (south + lit(30 / 3600)).alias("north")
    )
    return F.when(mesh.rlike("^[0-9]{8}$"), box)


#: GRS80, and zone IX of the Japanese plane rectangular system.
_A, _F = 6_378_137.0, 1 / 298.257222101
_LAT0, _LON0, _K0 = math.radians(36.0), math.radians(139 + 50 / 60), 0.9999
_N = _F / (2 - _F)
_RADIUS = _K0 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_C = 2 * math.sqrt(_N) / (1 + _N)


def _northing0() -> float:
    s = math.sin(_LAT0)
    xi = math.atan(math.sinh(math.atanh(s) - _C * math.atanh(_C * s)))
    return _RADIUS * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(_ALPHA)))


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres (EPSG:6677) by the Krueger series to order four."""
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - lit(_C) * F.atanh(lit(_C) * s))
    dl = F.radians(lon) - lit(_LON0)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(lit(1) + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + lit(a) * F.cos(lit(2 * j) * xi) * F.sinh(lit(2 * j) * eta)
        y = y + lit(a) * F.sin(lit(2 * j) * xi) * F.cosh(lit(2 * j) * eta)
    return lit(_RADIUS) * x, lit(_RADIUS) * y - lit(_northing0())


def projection_sql(lon: str, lat: str) -> tuple[str, str]:
    """The same series as SQL text."""
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {_C!r} * atanh({_C!r} * {s}))"
    dl = f"(radians({lon}) - {_LON0!r})"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + {t} * {t}))"
    x, y = [eta], [xi]
    for j, a in enumerate(_ALPHA, 1):
        x.append(f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})")
        y.append(f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})")
    return f"{_RADIUS!r} * ({' + '.join(x)})", f"{_RADIUS!r} * ({' + '.join(y)}) - {_northing0()!r}"
