"""Plans and SQL of the registered queries."""

import pytest
from pyspark.sql import functions as F

from pedshade.operators import overlay, routing, trees, windows
from pedshade.plans import fixtures, queries
from pedshade.runtime import Scratch
from pedshade.sources import publish

SF = "/root/testdata/sf0.001"


def test_edges_never_pair_all_nodes(spark):
    """A filter on edge ids must not join the two ends of an edge before the grid's width is known."""
    edges = fixtures.load(spark, SF, "road_edges")
    ends = edges.filter("edge_id is not null").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).filter("u < v")
    for df in (edges.filter("edge_id is not null"), ends, edges.join(edges.select("edge_id"), "edge_id", "left_anti")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin BuildRight, Inner" not in plan and "NestedLoopJoin BuildLeft" not in plan and "CartesianProduct" not in plan
        # The nested loops that are left have the grid's one row on their right.
        assert "NestedLoopJoin BuildRight, Cross, (" not in plan


def test_places_of_a_large_graph_are_not_broadcast(spark):
    """Nodes in order pack into files below the planner's limit, so size alone does not keep them from the driver."""
    scratch = Scratch(spark, "places")
    k = F.col("id")
    nodes = scratch.write(spark.range(40_000).select(k.alias("node_id"), ((k % 200) / 1000).alias("lon"), (F.floor(k / 200) / 1000).alias("lat")))
    edges = scratch.write(spark.range(39_999).select(k.cast("string").alias("edge_id"), k.alias("source"), (k + 1).alias("target"), F.lit(1.0).alias("cost")))
    plans, write = [], Scratch.write

    def seen(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Scratch, "write", seen)
        graph = windows.Windows(edges, ["cost"], nodes)
        overlay.Overlay(edges, ["cost"], nodes, places=graph.places.select("node", "b"))
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line and "[node" in line or "Join [source" in line or "Join [target" in line]
    assert len(joins) >= 6 and not any("BroadcastHashJoin" in line for line in joins)


def test_equal_intervals_are_one_island_in_sql():
    """Of equal intervals either may open the island; with 400 rows a key, equal ones change places between two sorts."""
    import duckdb

    sql = queries._merge_sql("src", "out")
    c = duckdb.connect()
    c.execute("""CREATE TABLE src AS SELECT k AS edge_key, '12:00' AS scenario, CAST(j * 10 AS DOUBLE) AS s, CAST(j * 10 + 4 AS DOUBLE) AS e
     FROM (SELECT unnest(range(20000)) AS k), (SELECT unnest(range(6)) AS j), (SELECT unnest(range(3)) AS copy) ORDER BY hash(k, j, copy)""")
    got = c.execute(f"WITH {sql} SELECT count(*), max(e - s) FROM out").fetchone()
    assert got == (120000, 4.0)


def test_lines_reach_python_once_for_all_their_tiles(spark):
    """Tiles are listed with a line; rows do not multiply before they are encoded."""
    line = spark.createDataFrame([("a", [(139.7, 35.6), (139.95, 35.8)])], "edge_id string, geometry array<struct<lon: double, lat: double>>")
    tiles = publish.vector_tiles(line, ["edge_id"])
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Generate" not in plan
    got = [(r.z, r.x, r.y, r.n_features) for r in tiles.collect()]
    assert len(got) > 4 and {z for z, *_ in got} == {10, 11, 12, 13} and {n for *_, n in got} == {1}


def test_large_tiles_take_time_in_proportion():
    """A tile of many distinct values is put together in one piece."""
    import time

    def seconds(n):
        line = publish.encode_line([(0.0, 0.0), (9.0, 9.0)])
        began = time.perf_counter()
        publish.assemble_tile([(line, {"edge_id": f"edge-{k:09}-{'x' * 40}"}) for k in range(n)])
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 10 * seconds(20_000)


def test_tree_costs_by_both_strategies(spark):
    """A graph that fits is searched tree by tree; rounds of joins give the same."""
    rows = [(f"e{k:03}", (k * 7) % 23, (k * 11 + 3) % 23, float(k % 9 + 1)) for k in range(60)]
    edges = spark.createDataFrame(rows, "edge_id string, source long, target long, cost double")
    sources = spark.createDataFrame([(0,), (5,), (5,), (99,), (None,)], "source long")
    got = [sorted((r.source, r.node, r.cost) for r in routing.tree_costs(edges, sources, "cost", cap).collect()) for cap in (10**6, 0)]
    assert got[0] == got[1] and (99, 99, 0.0) in got[0] and len({s for s, *_ in got[0]}) == 3
    plans = [routing.tree_costs(edges, sources, "cost", cap)._jdf.queryExecution().executedPlan().toString() for cap in (10**6, 0)]
    assert "MapInPandas" in plans[0] and "MapInPandas" not in plans[1]


def test_trees_from_tile_to_tile(spark, monkeypatch):
    """Trees of a placed graph go through tiles in batches of sources: one-way streets, parallel edges, islands and unknown sources as in a search."""
    monkeypatch.setattr(trees, "BATCH_SOURCES", 2)
    at = lambda x, y: 12 * y + x
    rows = [(at(x, y), at(x + dx, y + dy)) for x in range(12) for y in range(12) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= x + dx < 12 and 0 <= y + dy < 12]
    rows = [(s, t) for s, t in rows if not (s % 5 == 0 and t > s)] + [(at(3, 3), at(3, 4)), (200, 201)]
    edges = spark.createDataFrame([(f"e{k}", s, t, float((7 * s + 11 * t + k) % 10)) for k, (s, t) in enumerate(rows)], "edge_id string, source long, target long, cost double")
    nodes = spark.createDataFrame([(at(x, y), 139 + x / 1000, 35 + y / 1000) for x in range(12) for y in range(12)] + [(200, 140.0, 36.0)], "node_id long, lon double, lat double")
    sources = spark.createDataFrame([(0,), (77,), (77,), (143,), (30,), (200,), (999,), (None,)], "source long")
    relaxed = routing.relaxed_tree
    monkeypatch.setattr(routing, "relaxed_tree", None)  # no rounds of joins
    got = sorted((r.source, r.node, r.cost) for r in trees.tiled_trees(edges, sources, nodes, 8, 3).collect())
    assert got == sorted((r.source, r.node, r.cost) for r in routing.tree_costs(edges, sources, nodes=nodes, max_edges=10**6).collect())
    assert got == sorted((r.source, r.node, r.cost) for r in routing.tree_costs(edges, sources, nodes=nodes, max_edges=0, block_nodes=16).collect())
    assert got == sorted((r.source, r.node, r.cost) for r in relaxed(edges, sources).collect())
    assert (999, 999, 0.0) in got and (200, 201, float((7 * 200 + 11 * 201 + len(rows) - 1) % 10)) in got
