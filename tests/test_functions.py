"""Scalar functions against hand-computed values."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pedshade.config import DEFAULT, Config
from pedshade.functions import compare, exposure, geo, solar


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def column(spark, values, fn, kind="double"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_water_tiers(spark):
    got = column(spark, [0.0, 100.0, 100.01, 300.0, 300.01, 500.0, 500.01, None], geo.water_penalty)
    assert got == [0, 0, 0.3, 0.3, 0.6, 0.6, 1, None]
    for bad in (-1.0, float("nan")):
        with pytest.raises(Exception, match="water distance"):
            column(spark, [bad], geo.water_penalty)


def test_mesh(spark):
    r = one(spark, m=geo.mesh_id(F.lit(139.7575), F.lit(35.683)), b=geo.mesh_bounds(F.lit("53394610")), n=geo.mesh_bounds(F.lit("5339461")))
    assert r.m == "53394610" and r.n is None
    assert r.b.west <= 139.7575 < r.b.east and r.b.south <= 35.683 < r.b.north


def test_projection_anchor(spark):
    x, y = geo.project(F.lit(139.75), F.lit(35.68))
    r = one(spark, x=x, y=y)
    assert abs(r.x + 7543.124) < 0.01 and abs(r.y + 35499.182) < 0.01


def test_rounding_halves_up(spark):
    assert column(spark, [-0.00000025, 0.00000025, 139.12345675], geo.quantize) == [-2, 3, math.floor(139.12345675 * 1e7 + 0.5)]


def test_distances(spark):
    a = [F.lit(x) for x in (139.0, 35.0, 139.01, 35.01)]
    r = one(spark, h=geo.haversine(*a), e=geo.equirectangular(*a))
    assert abs(r.h - r.e) < 1 and 1400 < r.h < 1500


def test_bbox(spark):
    rows = [(1.0, 1.0), (2.0, 3.0), (0.999, 1.0), (None, 1.0), (float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert [r.v for r in df.select(geo.in_bbox(F.col("x"), F.col("y"), (1, 1, 2, 3)).alias("v")).collect()] == [True, True, False, False, False]


def test_solar_reference_case(spark):
    az, el = solar.solar_position(F.lit(1066419030.0), F.lit(39.742476), F.lit(-105.1786))
    r = one(spark, az=az, el=el)
    assert abs(r.az - 194.34024) < 0.1 and abs(r.el - 39.87205) < 0.1


def test_scenarios_are_instants(spark):
    rows = solar.scenarios(spark).select("scenario", F.unix_timestamp("instant").alias("u")).orderBy("ordinal").collect()
    assert [(r.scenario, r.u) for r in rows] == [("09:00", 1790121600), ("12:00", 1790132400), ("15:00", 1790143200)]


def test_shadow_vertex(spark):
    z = F.lit(0.0)
    r = one(spark, p=solar.project_vertex(z, z, F.lit(10.0), z, F.lit(90.0), F.lit(45.0)))
    assert abs(r.p.x + 10) < 1e-9 and abs(r.p.y) < 1e-9
    with pytest.raises(Exception, match="elevation"):
        one(spark, p=solar.project_vertex(z, z, F.lit(10.0), z, F.lit(90.0), F.lit(0.0)))


def edges(spark, rows):
    return spark.createDataFrame(rows, "edge_id string, length double, green_score double, water_penalty double, shade_1200 double")


def test_exposure_and_cost(spark):
    df = edges(spark, [("a", 100.0, 1.0, 0.0, 1.0), ("b", 300.0, 0.0, 1.0, 0.0)])
    r = df.select(exposure.base_exposure().alias("x"), exposure.exposure("12:00").alias("s"), exposure.edge_cost("fastest").alias("f"), exposure.edge_cost("coolest").alias("c")).collect()
    assert [tuple(x) for x in r] == [(0, 0, 100, 100), (1, 1, 300, 1200)]
    bad = edges(spark, [("a", 100.0, 1.5, 0.0, 1.0)])
    with pytest.raises(Exception, match="green_score"):
        bad.select(exposure.base_exposure()).collect()
    assert bad.select(exposure.base_exposure(strict=False).alias("x")).first().x < 0
    # The fastest mode never reads the environment.
    assert bad.select(exposure.edge_cost("fastest").alias("c")).first().c == 100
    with pytest.raises(ValueError, match="scenario"):
        exposure.exposure("10:00")


def test_config_checks():
    for bad in ({"green_weight": 0.6}, {"walking_speed": 0}, {"shade_weight": 2}, {"coolest_lambda": -1}, {"max_extra_distance_ratio": float("nan")}, {"bbox": (1, 0, 0, 1)}):
        with pytest.raises(ValueError):
            DEFAULT.with_(**bad)
    with pytest.raises(ValueError):
        Config().lam("slowest")


def test_strata(spark):
    got = column(spark, [399.999, 400.0, 1000.0, 2000.0, 3500.0, 3500.001, float("nan"), None], compare.stratum)
    assert got == [None, "short", "medium", "long", "long", None, None, None]


def test_detour_guard(spark):
    c = DEFAULT.with_(max_extra_distance_ratio=0.25)
    assert column(spark, [1250.0, 1250.01], lambda x: compare.passes_detour_guard(x, F.lit(1000.0), c)) == [True, False]
    assert column(spark, [9e9], lambda x: compare.passes_detour_guard(x, F.lit(1.0), DEFAULT)) == [True]


def test_display_texts(spark):
    assert column(spark, [999.4, 999.5, 1000.0, 1365.0, 1500.0, 12340.0, -1.0, None], compare.format_distance) == ["999 m", "1000 m", "1 km", "1.36 km", "1.5 km", "12.3 km", "—", "—"]
    assert column(spark, [0.0, 59.0, 61.0, float("nan")], compare.format_walking_time) == ["0分", "1分", "2分", "—"]
    assert column(spark, [-30.0, 30.0, 61.0, None], compare.format_extra_time) == ["−30秒", "+30秒", "+2分", "比較不可"]
    assert column(spark, [12.5, -12.5, 0.0, None], lambda x: compare.format_percent(x, True)) == ["+13%", "−13%", "0%", "比較不可"]
    assert column(spark, [-2.5], compare.format_percent) == ["-2%"]
    assert column(spark, [0.125, 0.375, 1.005, None], compare.format_score) == [f"{0.13}", f"{0.38}", "1.00", "—"]
    text = column(spark, [None, 0.0, 25.0], lambda x: compare.tradeoff_text(x, F.lit(2.0)))
    assert text[0] == "比較不可" and text[1] == compare.CHECK_DIFFERENCE and text[2].startswith("2分") and "25%" in text[2]
    assert column(spark, ["snap", "else"], compare.user_message, "string") == [compare.MESSAGES["snap"], compare.OTHER_MESSAGE]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1e4, allow_nan=False), min_size=1, max_size=40))
def test_fixed_decimals_follow_the_binary_value(values):
    from decimal import ROUND_HALF_UP, Decimal

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    got = column(spark, values, lambda x: compare.to_fixed(x, 2))
    assert got == [str(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values]


def test_normalizer_and_ramp(spark):
    assert str(column(spark, [-1e-15], compare.normalized)[0]) == "0.0"
    with pytest.raises(Exception, match="finite"):
        column(spark, [float("inf")], compare.normalized)
    assert column(spark, [-1.0, 0.35, 0.7, 0.85, 2.0], lambda x: compare.ramp(x, [(0, 0), (0.7, 1), (1, 3)])) == pytest.approx([0, 0.5, 1, 2, 3])
    assert one(spark, u=compare.asset_url(F.lit("/base//"), F.lit("/data/x.json"))).u == "/base/data/x.json"


def test_costs_and_intervals_of_users(spark):
    from pedshade.functions import extensions
    from pedshade.operators import routing

    edges = spark.createDataFrame([("a", 1, 2, 1.0, 9.0), ("b", 1, 2, 2.0, 1.0), ("c", 2, 3, 1.0, None)], "edge_id string, source long, target long, length double, heat double")
    od = spark.createDataFrame([(1, 1, 2)], "od_id long, source long, target long")
    warm = lambda length, heat: length + np.nan_to_num(heat)
    costs = {"short": F.col("length"), "cool": extensions.cost_function(warm, "length", "heat")}
    for cap in (10**6, 0):
        got = {r["mode"]: (r.edge_ids, r.total_cost) for r in routing.shortest_paths(od, edges, costs, cap).collect()}
        assert got == {"short": (["a"], 1.0), "cool": (["b"], 3.0)}
    with pytest.raises(ValueError, match="negative"):
        routing.shortest_paths(od, edges, {"m": extensions.cost_function(lambda x: -x, "length")})
    with pytest.raises(Exception, match="shape"):
        edges.select(extensions.cost_function(lambda x: x[:0], "length")).collect()

    extensions.register(spark)
    square = "array(array(named_struct('x', 1d, 'y', -1d), named_struct('x', 3d, 'y', -1d), named_struct('x', 3d, 'y', 1d), named_struct('x', 1d, 'y', 1d)))"
    line = "array(named_struct('x', 0d, 'y', 0d), named_struct('x', 9d, 'y', 0d))"
    assert [tuple(r) for r in spark.sql(f"SELECT i.* FROM VALUES (1), (2) t(k), LATERAL line_intervals({line}, {square}) i").collect()] == [(1.0, 3.0)] * 2
    null = "cast(null as array<struct<x: double, y: double>>)"
    assert spark.sql(f"SELECT i.* FROM VALUES (1) t(k), LATERAL line_intervals({null}, {square}) i").count() == 0
    with pytest.raises(Exception, match="rings must hold"):
        spark.sql(f"SELECT * FROM line_intervals({line}, {line})").collect()
