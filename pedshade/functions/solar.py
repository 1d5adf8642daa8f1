"""Solar position by Meeus's published equations, without refraction, and shadow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedshade.config import SCENARIO_DATE, SCENARIO_ZONE, SCENARIOS


def _lit(x: float) -> Column:
    return F.lit(float(x))


def _wrap(x: Column, m: float) -> Column:
    return F.pmod(x, _lit(m))


def scenarios(spark: SparkSession) -> DataFrame:
    """``(ordinal, scenario, instant)``: the reference date's local times as instants."""
    rows = spark.createDataFrame(list(enumerate(SCENARIOS)), "ordinal int, scenario string")
    local = F.concat(F.lit(f"{SCENARIO_DATE} "), "scenario", F.lit(f":00 {SCENARIO_ZONE}"))
    return rows.withColumn("instant", local.cast("timestamp"))


def _series(t: Column, *coefficients: float) -> Column:
    """Polynomial in t, coefficients in ascending order."""
    out = _lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = _lit(c) + t * out
    return out


def sun_coordinates(T: Column) -> tuple[Column, Column]:
    """(declination in radians, equation of time in minutes) for Julian centuries T since J2000.

    Meeus, Astronomical Algorithms, 2nd edition: L0, M, e, C, Omega and lambda
    of chapter 25, the obliquity epsilon by (22.2) and (25.8), declination by
    (25.7), equation of time by (28.3).
    """
    L0 = _wrap(_series(T, 280.46646, 36000.76983, 0.0003032), 360)
    M = F.radians(_series(T, 357.52911, 35999.05029, -0.0001537))
    e = _series(T, 0.016708634, -0.000042037, -0.0000001267)
    amplitudes = ((1.914602, -0.004817, -0.000014), (0.019993, -0.000101), (0.000289,))
    C = sum((_series(T, *a) * F.sin(_lit(k) * M) for k, a in enumerate(amplitudes, 1)), _lit(0))
    Omega = F.radians(_series(T, 125.04, -1934.136))
    lambda_ = F.radians(L0 + C - _lit(0.00569) - _lit(0.00478) * F.sin(Omega))
    epsilon0 = _lit(23 + 26 / 60) + _series(T, 21.448, -46.815, -0.00059, 0.001813) / _lit(3600)
    epsilon = F.radians(epsilon0 + _lit(0.00256) * F.cos(Omega))
    delta = F.asin(F.sin(epsilon) * F.sin(lambda_))
    L, y = F.radians(L0), F.pow(F.tan(epsilon / _lit(2)), _lit(2))
    terms = (
        (y, F.sin(_lit(2) * L)), (_lit(-2) * e, F.sin(M)), (_lit(4) * e * y, F.sin(M) * F.cos(_lit(2) * L)),
        (_lit(-0.5) * y * y, F.sin(_lit(4) * L)), (_lit(-1.25) * e * e, F.sin(_lit(2) * M)),
    )
    E = sum((k * f for k, f in terms), _lit(0))
    return delta, F.degrees(E) * _lit(4)


def solar_position(unix_seconds: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(azimuth clockwise from north, elevation) in degrees for seconds since 1970 UTC.

    Horizontal coordinates by Meeus (13.5) and (13.6), whose azimuth counts from
    the south; the hour angle H follows from true solar time.
    """
    JDE = unix_seconds / _lit(86400) + _lit(2440587.5)
    delta, E = sun_coordinates((JDE - _lit(2451545)) / _lit(36525))
    solar_minutes = _wrap(_wrap(unix_seconds, 86400) / _lit(60) + E + _lit(4) * lon, 1440)
    H, phi = F.radians(solar_minutes / _lit(4) - _lit(180)), F.radians(lat)
    A = F.atan2(F.sin(H), F.cos(H) * F.sin(phi) - F.tan(delta) * F.cos(phi))
    h = F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.cos(H)
    return _wrap(F.degrees(A) + _lit(180), 360), F.degrees(F.asin(F.greatest(_lit(-1), F.least(_lit(1), h))))


def project_vertex(x: Column, y: Column, z: Column, ground: Column, azimuth: Column, elevation: Column) -> Column:
    """Where a point's shadow falls on the ground: struct (x, y); an error unless 0 < elevation < 90."""
    ok = (elevation > 0) & (elevation < 90)
    tan = F.when(ok, F.tan(F.radians(elevation))).otherwise(F.raise_error(F.lit("solar elevation must lie in (0, 90)")).cast("double"))
    d = (z - ground) / tan
    return F.struct((x - d * F.sin(F.radians(azimuth))).alias("x"), (y - d * F.cos(F.radians(azimuth))).alias("y"))


