"""Unions, differences and repair of polygons against areas and points."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pedshade.operators import cover, dissolve
from pedshade.operators.dissolve import combine, common, difference, is_simple, signed_area
from pedshade.operators.polygons import inside, union_areas
from tests.test_operators import PRISM, none, prism


def area(parts):
    return sum(signed_area(ring) for part in parts for ring in part)


def arrays(parts):
    return [[np.array(ring) for ring in part] for part in parts]


def box(w, s, e, n):
    return [np.array([(w, s), (e, s), (e, n), (w, n)], float)]


def plain(rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def test_neighbours_become_one_ring():
    whole = [[(0, 0), (4, 0), (4, 2), (0, 2)]]
    assert combine([box(0, 0, 2, 2), box(2, 0, 4, 2)]) == [whole] == combine([box(0, 0, 3, 2), box(1, 0, 4, 2), box(1, 0, 4, 2)])
    assert combine([]) == [] == combine([[np.zeros((0, 2))]]) == combine([box(0, 0, 1, 0)])


def test_holes_come_out_with_their_islands():
    frame_ = [box(0, 0, 9, 1), box(0, 8, 9, 9), box(0, 0, 1, 9), box(8, 0, 9, 9)]
    island = combine([*frame_, box(3, 3, 5, 5)])
    assert [[len(r) for r in part] for part in island] == [[4, 4], [4]]
    assert area(island) == 81 - 49 + 4 and signed_area(island[0][1]) == -49
    assert area(combine([box(0, 0, 9, 9)], [box(3, 3, 5, 5)], difference)) == 77
    assert combine([box(0, 0, 4, 4)], [box(0, 0, 4, 4)], difference) == []


@pytest.mark.parametrize("rings, sizes, total", [
    ([[(0, 0), (2, 2), (2, 0), (0, 2)]], [[3], [3]], 2),  # crosses itself
    ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 0), (3, 1), (2, 2), (1, 1)]], [[4, 4]], 14),  # a hole that touches the outer ring
    ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 0), (4, 2), (2, 4), (0, 2)]], [[3]] * 4, 8),  # one that parts it
    ([[(0, 0), (4, 0), (4, 4), (0, 4)]] * 2, [], 0),  # a ring drawn twice is open
    ([[(0, 0), (4, 0), (4, 4), (8, 4), (4, 4), (0, 4)]], [[4]], 16),  # a spike
    ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(3, 1), (6, 1), (6, 3), (3, 3)]], [[4], [8]], 18),  # a hole that leaves the outer ring
])
def test_mended_outlines(rings, sizes, total):
    rings = [np.array(r, float) for r in rings]
    parts = combine([rings])
    assert sorted([len(r) for r in p] for p in parts) == sorted(sizes) and area(parts) == total
    touching = sizes == [[4, 4]]
    assert is_simple(rings, parts) == touching
    for part in parts:
        assert is_simple(arrays([part])[0], combine(arrays([part])))


corner = st.tuples(st.integers(0, 6), st.integers(0, 6))
polygon = st.lists(st.lists(corner, min_size=3, max_size=6), min_size=1, max_size=2).map(lambda p: [np.array(r, float) for r in p])


@settings(max_examples=15, deadline=None)
@given(st.lists(polygon, min_size=1, max_size=5), st.lists(polygon, max_size=2), st.randoms())
def test_areas_and_points_against_the_inputs(region, other, rnd):
    total, covered = union_areas(region, other)
    u, c, d = combine(region, other, lambda a, b: a), combine(region, other, common), combine(region, other, difference)
    assert (area(u), area(c), area(d)) == (pytest.approx(total, abs=1e-6), pytest.approx(covered, abs=1e-6), pytest.approx(total - covered, abs=1e-6))
    mixed = list(region)
    rnd.shuffle(mixed)
    assert area(combine(arrays(combine(mixed[:2])) + mixed[2:])) == pytest.approx(area(u), abs=1e-6)
    at = np.array([(x + 0.4142, y + 0.2361) for x in range(-1, 7) for y in range(-1, 7)])
    hit = lambda ps: np.any([inside(at, p) for p in ps], axis=0) if ps else np.zeros(len(at), bool)
    near = lambda ps: np.any([hit([[r + shift for r in p] for p in ps]) != hit(ps) for shift in np.array([(1e-6, 0), (-1e-6, 0), (0, 1e-6), (0, -1e-6)])], axis=0)
    clear = ~(near(region) | near(other))
    assert (hit(arrays(d)) == (hit(region) & ~hit(other)))[clear].all() and (hit(arrays(c)) == (hit(region) & hit(other)))[clear].all()
    assert all(signed_area(p[0]) > 0 and all(signed_area(h) < 0 for h in p[1:]) for p in [*u, *c, *d])


@settings(max_examples=60, deadline=None)
@given(polygon)
def test_rings_cut_to_a_square(rings):
    square = (1.5, 0.5, 4.5, 5.0)
    cut = [dissolve._clipped(r, *square) for r in rings]
    assert area(combine([[r for r in cut if len(r) >= 3]])) == pytest.approx(union_areas([box(*square)], [rings])[1], abs=1e-6)


def some(rnd, n):
    out = []
    for k in range(n):
        x, y = (rnd.random() * 14, rnd.random() * 14) if k % 3 else (2 + rnd.random(), 3 + rnd.random())  # a third lies in one square
        out.append([np.array([(x + rnd.random() * 6, y + rnd.random() * 6) for _ in range(4 + k % 2)]) for _ in range(1 + k % 2)])
    return out


def test_layers_are_united_and_subtracted(spark):
    rnd = random.Random(5)
    a, b = some(rnd, 24), some(rnd, 6)
    keyed = [(None if k % 2 else "k", p) for k, p in enumerate(a)]
    rows = [(k, plain(p), 1) for k, p in keyed] + [("k", plain(a[0]), 1)] * 40 + [("k", [], 1), ("k", None, 1)]
    schema = f"key string, rings {cover.POLYGON}, batch int"
    layer = spark.createDataFrame(rows, schema)
    other = spark.createDataFrame([(k, plain(p), 1) for p in b for k in ("k", None)], schema)
    sums = lambda df: {(r.key, r.cx, r.cy): r.area for r in df.groupBy("key", "cx", "cy").agg(F.sum(dissolve.rings_area(F.col("rings"))).alias("area")).collect()}
    got = sums(dissolve.dissolve(layer, ["key"], 10.0, batch=3))
    turned = sums(dissolve.dissolve(layer.orderBy(F.xxhash64("rings")).repartition(7), ["key"], 10.0, batch=5))
    assert {r[0] for r in got} == {"k", None} and got.keys() == turned.keys()
    left = sums(dissolve.overlay(layer, other, ["key"], difference, 10.0, batch=4))
    both = sums(dissolve.overlay(layer, other, ["key"], common, 10.0, batch=4))
    for key in ("k", None):
        mine = [p for k, p in keyed if k == key]
        for cx in range(2):
            for cy in range(2):
                at = (key, cx, cy)
                sq = [box(cx * 10, cy * 10, cx * 10 + 10, cy * 10 + 10)]
                whole = union_areas(sq, mine)[1]
                assert got.get(at, 0) == pytest.approx(whole, abs=1e-6) and turned.get(at, 0) == pytest.approx(whole, abs=1e-6)
                rest = area(combine(arrays(combine(mine, sq, common)), b, difference))
                assert left.get(at, 0) == pytest.approx(rest, abs=1e-6) and both.get(at, 0) == pytest.approx(whole - rest, abs=1e-6)
    assert dissolve.dissolve(layer.limit(0), ["key"], 10.0).count() == 0 == dissolve.overlay(layer.limit(0), other, ["key"]).count()


def test_repair_keeps_columns(spark):
    twisted = [np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)]
    with_hole = [np.array([(0, 0), (9, 0), (9, 9), (0, 9)], float), np.array([(1, 1), (2, 1), (1, 2)], float)]
    df = spark.createDataFrame([(1, "t", plain(twisted)), (2, None, plain(with_hole)), (3, "e", []), (4, "n", None)], f"poly_id long, part string, rings {cover.POLYGON}")
    df = df.withColumnRenamed("part", "repaired_by")
    got = dissolve.repair(df).orderBy("poly_id", "part").collect()
    assert [(r.poly_id, r.repaired_by, r.part, r.repaired, [len(x) for x in r.rings]) for r in got] == [(1, "t", 0, True, [3]), (1, "t", 1, True, [3]), (2, None, 0, False, [4, 3])]


def test_shaded_ground_of_two_towers(spark):
    rows = [("two", 5.0, None, [{"part_id": "a", "lod1": none(1), "lod2": prism(0, 0, 10, 20, 2)}, {"part_id": "b", "lod1": none(1), "lod2": prism(5, 5, 15, 42, 2)}])]
    sun = spark.createDataFrame([("12:00", 180.0, 45.0)], "scenario string, azimuth double, elevation double")
    got = dissolve.ground_shade(cover.select_solids(spark.createDataFrame(rows, PRISM)), sun, 8.0)
    # Towers 2 m wide throw shadows 10 and 27 m long to the north.
    assert got.agg(F.sum(dissolve.rings_area(F.col("rings")))).first()[0] == pytest.approx(2 * 10 + 2 * 27)
    assert got.count() == 2 + 5


def test_polygons_with_rings_of_different_sizes(spark):
    """Holes with other numbers of corners, in every operator that takes polygons to Python workers."""
    one = [np.array([(-50, -50), (50, -50), (50, 50), (-50, 50)], float), np.array([(-1, -1), (1, -1), (0, 3)], float)]
    two = [np.array([(60, -50), (70, -50), (65, 50)], float)]
    polys = spark.createDataFrame([(1, plain(one)), (2, plain(two))], f"poly_id long, rings {cover.POLYGON}")
    lines = spark.createDataFrame([("e", [{"x": -40.0, "y": 0.0}, {"x": 80.0, "y": 0.0}])], "edge_id string, line array<struct<x: double, y: double>>")
    got = sorted((r.poly_id, round(r.s, 6), round(r.e, 6)) for r in cover.line_polygon_intervals(lines, polys, ["poly_id"]).collect())
    assert got == [(1, 0, 39.25), (1, 40.75, 90), (2, 102.5, 107.5)]
    assert cover.green_scores(lines, polys).first().green_score > 0.6
    assert cover.fragments(polys, 200.0).agg(F.sum("area")).first()[0] == pytest.approx(10_000 - 4 + 500)
