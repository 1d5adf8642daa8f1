"""Registered queries of the network engine, each over its whole tables, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pedshade.config import DEFAULT, SAMPLER_EARTH_RADIUS_M, SCENARIOS, SHADE_COLUMNS, SNAP_EARTH_RADIUS_M
from pedshade.functions import compare, exposure, extensions, geo, solar
from pedshade.operators import components, cover, dissolve, evaluation, intervals, ranks, repair, routes, rules, spatial
from pedshade.operators.routing import shortest_paths, tree_costs
from pedshade.plans.fixtures import load, with_views
from pedshade.runtime import Scratch
from pedshade.sources import graph_json
from pedshade.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOON = "12:00"
BBOX = DEFAULT.bbox


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql is not None:
            SQL[name or fn.__name__] = sql
        return fn

    return add


def r6(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def nodes_of(s, d):
    return load(s, d, "road_nodes")


def edges_of(s, d):
    return load(s, d, "road_edges")


# -- graph tables and rules ------------------------------------------------------

_BASE = "least(1e0, greatest(0e0, 0.7e0 * (1 - green_score) + 0.3e0 * water_penalty))"


def _shade_sql(col: str) -> str:
    return f"least(1e0, greatest(0e0, 0.75e0 * {_BASE} + 0.25e0 * (1 - {col})))"


@query(with_views("road_nodes", "road_edges") + f"""
SELECT (SELECT count(*) FROM road_nodes) AS n_nodes, count(*) AS n_edges, round(avg(length), 6) AS avg_length, max(length) AS max_length,
 (SELECT min(lon) FROM road_nodes) AS west, (SELECT min(lat) FROM road_nodes) AS south, (SELECT max(lon) FROM road_nodes) AS east,
 (SELECT max(lat) FROM road_nodes) AS north,
 (SELECT round(avg(CASE WHEN lon BETWEEN {BBOX[0]} AND {BBOX[2]} AND lat BETWEEN {BBOX[1]} AND {BBOX[3]} THEN 1e0 ELSE 0e0 END), 6) FROM road_nodes) AS inside
FROM road_edges""")
def graph_statistics(s, d):
    n = nodes_of(s, d).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"),
        r6(F.avg(geo.in_bbox(F.col("lon"), F.col("lat"), BBOX).cast("double"))).alias("inside"),
    )
    e = edges_of(s, d).agg(F.count(F.lit(1)).alias("n_edges"), r6(F.avg("length")).alias("avg_length"), F.max("length").alias("max_length"))
    return n.crossJoin(e)  # one row each


_WIDE = (BBOX[0] - 0.01, BBOX[1] - 0.01, BBOX[2] + 0.01, BBOX[3] + 0.01)
#: A box around the first half of the grid's columns: the rest of the nodes lies outside.
_AREA = (139.6, 35.54, 139.61, 35.56)


@query(with_views("road_nodes") + f""", s AS (SELECT avg(CASE WHEN lon BETWEEN {_AREA[0]} AND {_AREA[2]} AND lat BETWEEN {_AREA[1]} AND {_AREA[3]} THEN 1e0 ELSE 0e0 END) AS share,
 (min(lon) + max(lon)) / 2 AS cx, (min(lat) + max(lat)) / 2 AS cy FROM road_nodes)
SELECT 'far-outside' AS rule, CAST(node_id AS VARCHAR) AS key FROM road_nodes
WHERE NOT (lon BETWEEN {_AREA[0]}::DOUBLE - 0.01 AND {_AREA[2]}::DOUBLE + 0.01 AND lat BETWEEN {_AREA[1]}::DOUBLE - 0.01 AND {_AREA[3]}::DOUBLE + 0.01)
UNION ALL SELECT 'few-inside', 'graph' FROM s WHERE share < 0.9
UNION ALL SELECT 'centre-outside', 'graph' FROM s WHERE NOT (cx BETWEEN {_AREA[0]} AND {_AREA[2]} AND cy BETWEEN {_AREA[1]} AND {_AREA[3]})""")
def extent_violations(s, d):
    """A small area, which much of the network lies outside of."""
    return rules.extent(nodes_of(s, d), _AREA).select("rule", "key")


def _broken_edges(s, d):
    """The network's edges next to lineitem's, of which many break a rule."""
    li = load(s, d, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("edge_id"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"),
        F.col("l_quantity").cast("double").alias("length"), (F.col("l_discount") * 20 - 0.5).cast("double").alias("green_score"), F.col("l_tax").cast("double").alias("water_penalty"),
    )
    return li


_BROKEN = """be AS (SELECT concat_ws(':', l_orderkey, l_linenumber) AS edge_id, l_partkey AS source, l_suppkey AS target, CAST(l_quantity AS DOUBLE) AS length,
 CAST(l_discount * 20 - 0.5 AS DOUBLE) AS green_score, CAST(l_tax AS DOUBLE) AS water_penalty FROM lineitem)"""


@query("WITH " + _BROKEN + """, n AS (SELECT s_suppkey AS id FROM supplier)
SELECT 'source-missing' AS rule, edge_id AS key, CAST(source AS VARCHAR) AS detail FROM be WHERE source NOT IN (SELECT id FROM n)
UNION ALL SELECT 'target-missing', edge_id, CAST(target AS VARCHAR) FROM be WHERE target NOT IN (SELECT id FROM n)""")
def fk_violations(s, d):
    nodes = load(s, d, "supplier").select(F.col("s_suppkey").alias("node_id"))
    return rules.foreign_keys(_broken_edges(s, d), nodes)


@query("WITH " + _BROKEN + " SELECT 'duplicate-id' AS rule, edge_id AS key, CAST(count(*) AS VARCHAR) AS detail FROM be GROUP BY edge_id HAVING count(*) > 1")
def duplicate_edges(s, d):
    return rules.duplicates(_broken_edges(s, d), "edge_id")


@query("WITH " + _BROKEN + """ SELECT rule, count(*) AS n FROM (
SELECT 'length' AS rule FROM be WHERE NOT length > 0 UNION ALL SELECT 'green_score' FROM be WHERE NOT (green_score BETWEEN 0 AND 1)
UNION ALL SELECT 'water_penalty' FROM be WHERE NOT (water_penalty BETWEEN 0 AND 1)) GROUP BY rule""")
def edge_rule_violations(s, d):
    return rules.edge_values(_broken_edges(s, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_PLANTED = """, e0 AS (SELECT * REPLACE (CASE WHEN source % 50 = 1 THEN 0e0 ELSE length END AS length, CASE WHEN source % 50 = 2 THEN 1.5e0 ELSE green_score END AS green_score,
 CASE WHEN source % 50 = 3 THEN NULL ELSE water_penalty END AS water_penalty, CASE WHEN source % 50 = 4 THEN target + 1000000000 ELSE target END AS target),
 CASE WHEN source % 50 = 5 THEN 'short' WHEN source % 50 = 6 THEN 'turned' ELSE 'right' END AS line FROM road_edges),
pe AS (SELECT * FROM e0 UNION ALL SELECT * FROM e0 WHERE source % 50 = 7), pn AS (SELECT * FROM road_nodes UNION ALL SELECT * FROM road_nodes WHERE node_id % 50 = 8)"""


def _planted(s, d):
    """The network with a violation of each rule on nodes of some numbers."""
    k = F.col("source") % 50
    at = lambda n, v, c: F.when(k == n, v).otherwise(F.col(c))
    e = routes.edge_geometry(edges_of(s, d), nodes_of(s, d)).withColumns(
        {"length": at(1, F.lit(0.0), "length"), "green_score": at(2, F.lit(1.5), "green_score"), "water_penalty": at(3, F.lit(None).cast("double"), "water_penalty"),
         "target": F.when(k == 4, F.col("target") + 1_000_000_000).otherwise(F.col("target")),
         "geometry": F.when(k == 5, F.slice("geometry", 1, 1)).when(k == 6, F.reverse("geometry")).otherwise(F.col("geometry"))}
    )
    n = nodes_of(s, d)
    # The views are computed once, as every rule reads them.
    scratch = Scratch(s, "contract")
    return scratch.write(n.unionByName(n.filter("node_id % 50 = 8"))), scratch.write(e.unionByName(e.filter("source % 50 = 7")))


@query(with_views("road_nodes", "road_edges") + _PLANTED + """, v AS (
SELECT 'length' AS rule, edge_id AS key FROM pe WHERE NOT length > 0 UNION ALL SELECT 'green_score', edge_id FROM pe WHERE coalesce(NOT green_score BETWEEN 0 AND 1, true)
UNION ALL SELECT 'water_penalty', edge_id FROM pe WHERE coalesce(NOT water_penalty BETWEEN 0 AND 1, true) UNION ALL SELECT 'target-missing', edge_id FROM pe WHERE target NOT IN (SELECT node_id FROM pn)
UNION ALL SELECT 'geometry-short', edge_id FROM pe WHERE line = 'short' UNION ALL SELECT 'duplicate-id', edge_id FROM pe GROUP BY edge_id HAVING count(*) > 1
UNION ALL SELECT 'duplicate-node', CAST(node_id AS VARCHAR) FROM pn GROUP BY node_id HAVING count(*) > 1
UNION ALL SELECT 'geometry-ends', edge_id FROM pe WHERE line = 'turned' AND EXISTS (SELECT 1 FROM pn WHERE node_id = target))
SELECT DISTINCT rule, key FROM v""")
def graph_contract(s, d):
    return rules.graph(*_planted(s, d)).select("rule", "key").distinct()


@query(with_views("road_edges") + """, c AS (SELECT source, target, count(*) AS n FROM road_edges GROUP BY 1, 2)
SELECT count(CASE WHEN n > 1 THEN 1 END) AS parallel_pairs, CAST(sum(n - 1) AS BIGINT) AS surplus_edges FROM c""")
def parallel_edge_counts(s, d):
    c = edges_of(s, d).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count_if(F.col("n") > 1).alias("parallel_pairs"), F.sum(F.col("n") - 1).alias("surplus_edges"))


@query(with_views("road_nodes", "road_edges") + """, deg AS (SELECT node_id, count(edge_id) AS n FROM road_nodes LEFT JOIN road_edges ON source = node_id GROUP BY 1)
SELECT node_id, n AS out_degree, CAST(coalesce(sum(n) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_slot FROM deg""")
def csr_offsets(s, d):
    """Exclusive prefix sums of out-degrees: within ranges of ids, then over the ranges' totals."""
    deg = nodes_of(s, d).join(edges_of(s, d).groupBy(F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("n")), "node_id", "left").na.fill(0, ["n"])
    ranged = deg.withColumn("_block", F.floor(F.col("node_id") / 4096))
    totals = ranged.groupBy("_block").agg(F.sum("n").alias("t"))
    before = totals.select("_block", F.coalesce(F.sum("t").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("_block").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("inner", inner).join(before, "_block").select("node_id", F.col("n").cast("long").alias("out_degree"), (F.col("base") + F.col("inner")).cast("long").alias("first_slot"))


@query(with_views("road_edges") + " SELECT edge_id, source, target FROM road_edges ORDER BY edge_id")
def canonical_order(s, d):
    return edges_of(s, d).select("edge_id", "source", "target").orderBy("edge_id")


@query(with_views("road_edges") + """, b AS (SELECT source // 4096 AS block, sha256(string_agg(concat(edge_id, '|', printf('%.6f', length)), chr(10) ORDER BY edge_id)) AS digest FROM road_edges GROUP BY 1)
SELECT sha256(string_agg(digest, chr(10) ORDER BY block)) AS fingerprint FROM b""")
def content_fingerprint(s, d):
    """Digest of the graph's canonical text: of blocks of nodes first, then of their digests in order."""
    return rules.fingerprint(edges_of(s, d), F.concat_ws("|", "edge_id", F.format_string("%.6f", "length")), "edge_id", F.floor(F.col("source") / 4096))


# -- exposure and cost ------------------------------------------------------------

@query(with_views("road_edges") + f" SELECT edge_id, round({_BASE}, 10) AS exposure FROM road_edges")
def edge_base_exposure(s, d):
    return edges_of(s, d).select("edge_id", r6(exposure.base_exposure(), 10).alias("exposure"))


@query(with_views("road_edges") + " SELECT edge_id, " + ", ".join(f"round({_shade_sql(c)}, 10) AS exposure_{c[-4:]}" for c in SHADE_COLUMNS.values()) + " FROM road_edges")
def edge_shade_exposure(s, d):
    return edges_of(s, d).select("edge_id", *[r6(exposure.exposure(k), 10).alias(f"exposure_{c[-4:]}") for k, c in SHADE_COLUMNS.items()])


_COSTS = f"""SELECT edge_id, length AS fastest, length * (1 + 1e0 * {_shade_sql('shade_1200')}) AS balanced,
 length * (1 + 3e0 * {_shade_sql('shade_1200')}) AS coolest FROM road_edges"""


@query(with_views("road_edges") + f", c AS ({_COSTS}) SELECT edge_id, round(fastest, 10) AS fastest, round(balanced, 10) AS balanced, round(coolest, 10) AS coolest FROM c")
def edge_costs(s, d):
    return edges_of(s, d).select("edge_id", *[r6(exposure.edge_cost(m, NOON), 10).alias(m) for m in ("fastest", "balanced", "coolest")])


@query(with_views("road_edges") + f", c AS ({_COSTS}) SELECT edge_id, round(balanced, 10) AS balanced, round(coolest, 10) AS coolest FROM c")
def edge_costs_by_function(s, d):
    """The same costs from a function of the user's over arrays of values."""
    def cost(lam):
        return lambda length, green, water, shade: length * (1 + lam * (0.75 * (0.7 * (1 - green) + 0.3 * water) + 0.25 * (1 - shade)))

    columns = ("length", "green_score", "water_penalty", "shade_1200")
    return edges_of(s, d).select("edge_id", *[r6(extensions.cost_function(cost(lam), *columns), 10).alias(m) for m, lam in (("balanced", 1.0), ("coolest", 3.0))])


@query(with_views("road_edges") + f", c AS ({_COSTS}) SELECT edge_id, round(balanced, 10) AS balanced, round(coolest, 10) AS coolest FROM c")
def edge_costs_unchecked(s, d):
    return edges_of(s, d).select("edge_id", *[r6(exposure.edge_cost(m, NOON, strict=False), 10).alias(m) for m in ("balanced", "coolest")])


def _profile_sql(c: str) -> str:
    return f"""SELECT '{c}' AS field, count(*) AS n, round(min({c}), 6) AS min, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(max({c}), 6) AS max,
 round(stddev_pop({c}), 6) AS std, count(CASE WHEN {c} = 0 THEN 1 END) AS zeros, count(CASE WHEN {c} = 1 THEN 1 END) AS ones, count(DISTINCT {c}) AS n_values FROM road_edges"""


@query(with_views("road_edges") + " " + " UNION ALL ".join(_profile_sql(c) for c in ("green_score", "water_penalty", "shade_1200")))
def exposure_quality_profile(s, d):
    rows = evaluation.long_form(edges_of(s, d), ["edge_id"], ["green_score", "water_penalty", "shade_1200"])
    v = F.col("value")
    rows = Scratch(s, "profile").write(rows)
    out = rows.groupBy("field").agg(
        F.count(v).alias("n"), r6(F.min(v)).alias("min"), r6(F.avg(v)).alias("mean"), r6(F.max(v)).alias("max"),
        r6(F.stddev_pop(v)).alias("std"), F.count_if(v == 0).alias("zeros"), F.count_if(v == 1).alias("ones"), F.count_distinct(v).alias("n_values"),
    )
    middle = ranks.quantiles(rows, ["field"], "value", (0.5,)).select("field", r6(F.col("q")[0]).alias("median"))
    return out.join(middle, "field")


@query(with_views("road_edges") + " SELECT water_penalty AS value, count(*) AS n FROM road_edges GROUP BY 1")
def value_histogram(s, d):
    return edges_of(s, d).groupBy(F.col("water_penalty").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT penalty, count(*) AS n FROM (SELECT CASE WHEN m <= 100 THEN 0e0 WHEN m <= 300 THEN 0.3e0 WHEN m <= 500 THEN 0.6e0 ELSE 1e0 END AS penalty
FROM (SELECT CAST(l_quantity * 14 AS DOUBLE) AS m FROM lineitem)) GROUP BY penalty""")
def water_tiers(s, d):
    m = (F.col("l_quantity") * 14).cast("double")
    return load(s, d, "lineitem").select(geo.water_penalty(m).alias("penalty")).groupBy("penalty").agg(F.count(F.lit(1)).alias("n"))


# -- geometry ------------------------------------------------------------------------

def _ends(s, d):
    n = nodes_of(s, d)
    a, b = n.alias("a"), n.alias("b")
    return edges_of(s, d).join(a, F.col("source") == F.col("a.node_id")).join(b, F.col("target") == F.col("b.node_id"))


_ENDS = ", ends AS (SELECT e.*, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat FROM road_edges e JOIN road_nodes a ON a.node_id = source JOIN road_nodes b ON b.node_id = target)"


def haversine_sql(a: str, b: str) -> str:
    return f"""{2 * SNAP_EARTH_RADIUS_M!r} * asin(least(1e0, sqrt(sin(radians({b}lat - {a}lat) / 2) * sin(radians({b}lat - {a}lat) / 2)
 + cos(radians({a}lat)) * cos(radians({b}lat)) * sin(radians({b}lon - {a}lon) / 2) * sin(radians({b}lon - {a}lon) / 2))))"""


def equirect_sql(a: str, b: str) -> str:
    x, y = f"(({b}lon - {a}lon) * cos(radians(({a}lat + {b}lat) / 2)))", f"({b}lat - {a}lat)"
    return f"sqrt({x} * {x} + {y} * {y}) * {math.pi / 180 * SAMPLER_EARTH_RADIUS_M!r}"


@query(with_views("road_nodes", "road_edges") + _ENDS + f" SELECT edge_id, round({haversine_sql('a', 'b')}, 4) AS metres FROM ends")
def haversine_pairs(s, d):
    m = geo.haversine(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    return _ends(s, d).select("edge_id", r6(m, 4).alias("metres"))


@query(with_views("road_nodes", "road_edges") + _ENDS + f" SELECT edge_id, round({equirect_sql('a', 'b')}, 4) AS metres FROM ends")
def equirect_pairs(s, d):
    m = geo.equirectangular(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    return _ends(s, d).select("edge_id", r6(m, 4).alias("metres"))


@query(with_views("road_nodes") + """, p AS (SELECT node_id, lon + 0.0003 AS lon, lat + 0.0003 AS lat FROM road_nodes),
a AS (SELECT *, floor(lat * 1.5) AS fa, floor(lon) - 100 AS fo FROM p),
b AS (SELECT *, lat * 60 - fa * 40 AS la, (lon - 100 - fo) * 60 AS lo FROM a), c AS (SELECT *, floor(la / 5) AS sa, floor(lo / 7.5) AS so FROM b)
SELECT node_id, concat(lpad(CAST(CAST(fa AS BIGINT) AS VARCHAR), 2, '0'), lpad(CAST(CAST(fo AS BIGINT) AS VARCHAR), 2, '0'), CAST(CAST(sa AS BIGINT) AS VARCHAR), CAST(CAST(so AS BIGINT) AS VARCHAR),
 CAST(CAST(floor((la - sa * 5) / 0.5) AS BIGINT) AS VARCHAR), CAST(CAST(floor((lo - so * 7.5) / 0.75) AS BIGINT) AS VARCHAR)) AS mesh FROM c""")
def mesh_ids(s, d):
    # A little inside the grid square, whose sides the nodes themselves lie on.
    return nodes_of(s, d).select("node_id", geo.mesh_id(F.col("lon") + 0.0003, F.col("lat") + 0.0003).alias("mesh"))


@query("""WITH m AS (SELECT c_custkey, lpad(CAST(53390000 + c_custkey % 8000 AS VARCHAR), 8, '0') AS mesh FROM customer),
x AS (SELECT mesh, 100 + CAST(substr(mesh, 3, 2) AS DOUBLE) + CAST(substr(mesh, 6, 1) AS DOUBLE) * (7.5 / 60) + CAST(substr(mesh, 8, 1) AS DOUBLE) * (45e0 / 3600) AS west,
 CAST(substr(mesh, 1, 2) AS DOUBLE) / 1.5 + CAST(substr(mesh, 5, 1) AS DOUBLE) * (5e0 / 60) + CAST(substr(mesh, 7, 1) AS DOUBLE) * (30e0 / 3600) AS south FROM m)
SELECT mesh, round(west, 9) AS west, round(south, 9) AS south, round(west + 45e0 / 3600, 9) AS east, round(south + 30e0 / 3600, 9) AS north FROM x""")
def mesh_bounds(s, d):
    m = load(s, d, "customer").select((F.lit(53390000) + F.col("c_custkey") % 8000).cast("string").alias("mesh"))
    b = m.withColumn("b", geo.mesh_bounds(F.col("mesh")))
    return b.select("mesh", *[r6(F.col(f"b.{x}"), 9).alias(x) for x in ("west", "south", "east", "north")])


@query(with_views("road_nodes") + f""", z AS (SELECT unnest([10, 11, 12, 13]) AS z),
t AS (SELECT z, CAST(floor((lon + 0.0003 + 180) / 360 * pow(2, z)) AS BIGINT) AS x,
 CAST(floor((1 - ln(tan(radians(lat + 0.0003)) + 1 / cos(radians(lat + 0.0003))) / {math.pi!r}) / 2 * pow(2, z)) AS BIGINT) AS y FROM road_nodes CROSS JOIN z)
SELECT z, x, y, count(*) AS n_nodes FROM t GROUP BY z, x, y""")
def tile_index(s, d):
    p = nodes_of(s, d).select((F.col("lon") + 0.0003).alias("lon"), (F.col("lat") + 0.0003).alias("lat"), F.explode(F.array(*map(F.lit, (10, 11, 12, 13)))).alias("z"))
    return p.groupBy("z", geo.tile_x(F.col("lon"), F.col("z")).alias("x"), geo.tile_y(F.col("lat"), F.col("z")).alias("y")).agg(F.count(F.lit(1)).alias("n_nodes"))


@query(with_views("road_nodes") + """, q AS (SELECT node_id, CAST(floor(lon * 10000000 + 0.5) AS BIGINT) AS qlon, CAST(floor(lat * 10000000 + 0.5) AS BIGINT) AS qlat FROM road_nodes)
SELECT node_id, qlon, qlat, qlon / 10000000e0 AS lon, qlat / 10000000e0 AS lat FROM q""")
def quantized_nodes(s, d):
    q = nodes_of(s, d).select("node_id", geo.quantize(F.col("lon")).alias("qlon"), geo.quantize(F.col("lat")).alias("qlat"))
    return q.select("*", geo.dequantize(F.col("qlon")).alias("lon"), geo.dequantize(F.col("qlat")).alias("lat"))


_X, _Y = geo.projection_sql("lon", "lat")


@query(with_views("road_nodes") + f" SELECT node_id, round({_X}, 3) AS x, round({_Y}, 3) AS y FROM road_nodes")
def projected_nodes(s, d):
    x, y = geo.project(F.col("lon"), F.col("lat"))
    return nodes_of(s, d).select("node_id", r6(x, 3).alias("x"), r6(y, 3).alias("y"))


@query(with_views("road_nodes", "snap_points") + f""", inside AS (SELECT *, lon BETWEEN {BBOX[0]} AND {BBOX[2]} AND lat BETWEEN {BBOX[1]} AND {BBOX[3]} AS ok FROM snap_points),
c AS (SELECT p.point_id, n.node_id, {haversine_sql('p.', 'n.')} AS dist FROM inside p JOIN road_nodes n
 ON p.ok AND abs(p.lat - n.lat) < 0.003 AND abs(p.lon - n.lon) < 0.004),
b AS (SELECT point_id, arg_min(node_id, struct_pack(d := dist, n := node_id)) AS node_id, min(dist) AS dist FROM c WHERE dist <= 300 GROUP BY 1)
SELECT p.point_id, CASE WHEN NOT p.ok THEN 'outside-area' WHEN b.node_id IS NULL THEN 'too-far' ELSE 'ok' END AS status, b.node_id, round(b.dist, 4) AS distance_m
FROM inside p LEFT JOIN b USING (point_id)""")
def snap_points(s, d):
    out = spatial.snap(load(s, d, "snap_points"), nodes_of(s, d))
    return out.select("point_id", "status", "node_id", r6(F.col("distance_m"), 4).alias("distance_m"))


_SX, _SY = geo.projection_sql("lon", "lat")


@query(with_views("road_nodes", "stations") + f""", p AS MATERIALIZED (SELECT node_id, {_SX} AS x, {_SY} AS y FROM road_nodes),
t AS MATERIALIZED (SELECT station_id, {_SX} AS sx, {_SY} AS sy FROM stations)
SELECT node_id, round(min(sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy))), 3) AS distance_m FROM p CROSS JOIN t GROUP BY node_id""")
def nearest_station(s, d):
    # Few splits hold many nodes, so they are dealt out, and written, before they are projected: a filter on x would be pushed ahead.
    n = Scratch(s, "stations").write(nodes_of(s, d).repartition("node_id"))
    points = spatial.with_projection(n).withColumnRenamed("node_id", "point_id")
    sites = spatial.with_projection(load(s, d, "stations")).withColumnRenamed("station_id", "site_id")
    return spatial.nearest(points, sites).select(F.col("point_id").alias("node_id"), r6(F.col("distance_m"), 3).alias("distance_m"))


@query(with_views("road_nodes", "road_edges") + _ENDS + """ SELECT edge_id, CASE WHEN hash_flip = 1 THEN 'reversed' WHEN hash_flip = 2 THEN 'straight' ELSE 'kept' END AS action, alon AS first_lon, alat AS first_lat
FROM (SELECT *, (source + target) % 3 AS hash_flip FROM ends)""")
def oriented_geometry(s, d):
    """Every third edge's geometry comes reversed, every third is missing."""
    point = lambda p: F.struct(F.col(f"{p}.lon").alias("lon"), F.col(f"{p}.lat").alias("lat"))
    k = (F.col("source") + F.col("target")) % 3
    line = F.when(k == 0, F.array(point("a"), point("b"))).when(k == 1, F.array(point("b"), point("a")))
    rows = _ends(s, d).select("edge_id", k.alias("k"), routes.oriented(line, point("a"), point("b")).alias("g"))
    action = F.when(F.col("k") == 1, "reversed").when(F.col("k") == 2, "straight").otherwise("kept")
    return rows.select("edge_id", action.alias("action"), F.col("g")[0]["lon"].alias("first_lon"), F.col("g")[0]["lat"].alias("first_lat"))


# -- shade ------------------------------------------------------------------------------

_LONG = "sl AS (" + " UNION ALL ".join(f"SELECT edge_id, '{k}' AS scenario, {c} AS score FROM road_edges" for k, c in SHADE_COLUMNS.items()) + ")"


def shade_rows(s, d):
    e = edges_of(s, d).select("edge_id", *[F.col(c).alias(k) for k, c in SHADE_COLUMNS.items()])
    return e.unpivot("edge_id", list(SHADE_COLUMNS), "scenario", "score")


@query(with_views("road_edges") + f", {_LONG} SELECT * FROM sl")
def shade_long(s, d):
    return shade_rows(s, d)


@query(with_views("road_edges") + " SELECT edge_id, shade_0900 AS shade0900, shade_1200 AS shade1200, shade_1500 AS shade1500 FROM road_edges")
def shade_wide(s, d):
    p = shade_rows(s, d).groupBy("edge_id").pivot("scenario", list(SCENARIOS)).agg(F.first("score"))
    return p.select("edge_id", *[F.col(f"`{k}`").alias(f"shade{k.replace(':', '')}") for k in SCENARIOS])


@query(with_views("road_edges") + """, have AS (SELECT edge_id FROM road_edges WHERE source % 5 <> 0 UNION ALL SELECT concat(edge_id, 'x') FROM road_edges WHERE source % 5 = 0)
SELECT 'shade-missing' AS rule, edge_id AS key, '' AS detail FROM road_edges WHERE source % 5 = 0
UNION ALL SELECT 'shade-unknown', edge_id, '' FROM have WHERE edge_id LIKE '%x'""")
def shade_missing_unknown(s, d):
    """A fifth of the edges' scores stand under other ids."""
    e = edges_of(s, d)
    moved = shade_rows(s, d).join(e.select("edge_id", "source"), "edge_id").withColumn("edge_id", F.when(F.col("source") % 5 == 0, F.concat("edge_id", F.lit("x"))).otherwise(F.col("edge_id"))).drop("source")
    return rules.shade(moved, e)


_KEYS = ["edge_key", "scenario"]


def _spans(s, d, kind):
    return load(s, d, "edge_intervals").filter(F.col("kind") == kind).select(*_KEYS, "s", "e")


def _merge_sql(src: str, out: str) -> str:
    return f"""{out}_r AS (SELECT *, max(e) OVER (PARTITION BY edge_key, scenario ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src} WHERE e - s > 1e-9),
{out}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY edge_key, scenario ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS island FROM {out}_r),
{out} AS (SELECT edge_key, scenario, min(s) AS s, max(e) AS e FROM {out}_i GROUP BY edge_key, scenario, island)"""


_SH = "sh0 AS (SELECT edge_key, scenario, s, e FROM edge_intervals WHERE kind = 'shadow'), fp0 AS (SELECT edge_key, scenario, s, e FROM edge_intervals WHERE kind = 'footprint')"
_CUT = _SH + ", " + _merge_sql("sh0", "sh") + ", " + _merge_sql("fp0", "fp") + """,
ev AS (SELECT edge_key, scenario, s AS p, 1 AS dl, 0 AS dr FROM sh UNION ALL SELECT edge_key, scenario, e, -1, 0 FROM sh
 UNION ALL SELECT edge_key, scenario, s, 0, 1 FROM fp UNION ALL SELECT edge_key, scenario, e, 0, -1 FROM fp),
pt AS (SELECT edge_key, scenario, p, sum(dl) AS dl, sum(dr) AS dr FROM ev GROUP BY 1, 2, 3),
dp AS (SELECT edge_key, scenario, p, lead(p) OVER w AS q, sum(dl) OVER w AS l, sum(dr) OVER w AS r FROM pt WINDOW w AS (PARTITION BY edge_key, scenario ORDER BY p)),
raw AS (SELECT edge_key, scenario, p AS s, q AS e FROM dp WHERE l > 0 AND r = 0 AND q IS NOT NULL), """ + _merge_sql("raw", "cut")


@query(with_views("edge_intervals") + ", " + _SH + ", " + _merge_sql("sh0", "sh") + " SELECT * FROM sh")
def interval_merge(s, d):
    return intervals.merge(_spans(s, d, "shadow"), _KEYS)


@query(with_views("edge_intervals") + ", " + _CUT + " SELECT * FROM cut")
def interval_subtract(s, d):
    return intervals.subtract(_spans(s, d, "shadow"), _spans(s, d, "footprint"), _KEYS)


@query(with_views("edge_intervals") + ", " + _CUT + """, k AS (SELECT DISTINCT edge_key, scenario FROM edge_intervals), m AS (SELECT edge_key, scenario, sum(e - s) AS m FROM cut GROUP BY 1, 2)
SELECT edge_key, scenario, round(least(1e0, coalesce(m, 0) / 60e0), 4) AS ratio FROM k LEFT JOIN m USING (edge_key, scenario)""")
def shade_ratio(s, d):
    lengths = load(s, d, "edge_intervals").select(*_KEYS).distinct().withColumn("length", F.lit(60.0))
    out = intervals.covered_ratio(_spans(s, d, "shadow"), _spans(s, d, "footprint"), lengths, _KEYS)
    return out.select(*_KEYS, r6(F.col("ratio"), 4).alias("ratio"))


# -- routes -----------------------------------------------------------------------------

# Distances by keyed relaxation, then the walk back over edges that lie on a shortest path.
_PATHS = f"""ec0 AS MATERIALIZED ({_COSTS}),
ec AS MATERIALIZED (UNPIVOT ec0 ON fastest, balanced, coolest INTO NAME mode VALUE cost),
es AS MATERIALIZED (SELECT e.edge_id, e.source, e.target, ec.mode, ec.cost FROM road_edges e JOIN ec USING (edge_id)),
start AS MATERIALIZED (SELECT DISTINCT source, mode FROM od_pairs CROSS JOIN (SELECT unnest(['fastest', 'balanced', 'coolest']) AS mode)),
r(src, mode, n, cost) USING KEY (src, mode, n) AS (
  SELECT source, mode, source, 0e0 FROM start
  UNION
  SELECT r.src, r.mode, e.target, min(r.cost + e.cost)
  FROM r JOIN es e ON e.mode = r.mode AND e.source = r.n
  LEFT JOIN recurring.r AS p ON p.src = r.src AND p.mode = r.mode AND p.n = e.target
  WHERE p.cost IS NULL OR r.cost + e.cost < p.cost
  GROUP BY r.src, r.mode, e.target),
dist AS MATERIALIZED (SELECT * FROM r),
via AS MATERIALIZED (SELECT d.src, d.mode, d.n, arg_min(e.source, e.edge_id) AS source, min(e.edge_id) AS edge_id
  FROM dist d JOIN es e ON e.mode = d.mode AND e.target = d.n JOIN dist a ON a.src = d.src AND a.mode = d.mode AND a.n = e.source
  WHERE a.cost + e.cost = d.cost AND d.n <> d.src GROUP BY 1, 2, 3),
back(od_id, src, mode, n, edge_id, hops) AS (
  SELECT o.od_id, o.source, d.mode, o.target, CAST(NULL AS VARCHAR), 0 FROM od_pairs o JOIN dist d ON d.src = o.source AND d.n = o.target
  UNION ALL
  SELECT b.od_id, b.src, b.mode, via.source, via.edge_id, b.hops + 1 FROM back b JOIN via ON via.src = b.src AND via.mode = b.mode AND via.n = b.n),
steps AS MATERIALIZED (SELECT b.od_id, b.mode, CAST(row_number() OVER (PARTITION BY b.od_id, b.mode ORDER BY b.hops DESC) - 1 AS INTEGER) AS seq, b.edge_id FROM back b WHERE b.hops > 0),
total AS MATERIALIZED (SELECT o.od_id, d.mode, d.cost FROM od_pairs o JOIN dist d ON d.src = o.source AND d.n = o.target)"""
_ROUTES = with_views("road_nodes", "road_edges", "od_pairs") + ", " + _PATHS
_SX12 = _shade_sql("shade_1200")
_METRICS = f""", m0 AS (SELECT s.od_id, s.mode, count(*) AS k, sum(length) AS l, sum(length * {_BASE}) AS x, sum(length * green_score) AS g, sum(length * water_penalty) AS w,
 sum(length * shade_1200) AS sh, sum(length * {_SX12}) AS sx, sum(length * (1 - shade_1200)) AS u FROM steps s JOIN road_edges USING (edge_id) GROUP BY 1, 2),
metrics AS MATERIALIZED (SELECT t.od_id, t.mode, coalesce(k, 0) AS edge_count, t.cost AS total_cost, coalesce(l, 0) AS distance_m, coalesce(l, 0) / 1.4e0 AS walking_s,
 coalesce(x / l, 0) AS average_exposure, coalesce(x, 0) AS exposure_load, coalesce(g / l, 0) AS green_indicator, CASE WHEN l > 0 THEN 1 - w / l ELSE 0 END AS water_access,
 coalesce(sh / l, 0) AS average_shade, coalesce(sx / l, 0) AS shade_average_exposure, coalesce(sx, 0) AS shade_exposure_load, coalesce(u, 0) AS unshaded_m
 FROM total t LEFT JOIN m0 USING (od_id, mode))"""
_METRIC_NAMES = "total_cost distance_m walking_s average_exposure exposure_load green_indicator water_access average_shade shade_average_exposure shade_exposure_load unshaded_m".split()
_COMPARED = {
    "extra_distance_m": "m.distance_m - f.distance_m",
    "extra_distance_pct": "(m.distance_m - f.distance_m) / nullif(f.distance_m, 0) * 100",
    "extra_walking_min": "(m.walking_s - f.walking_s) / 60",
    "average_exposure_change": "m.average_exposure - f.average_exposure",
    "average_exposure_reduction": "f.average_exposure - m.average_exposure",
    "average_exposure_reduction_pct": "(f.average_exposure - m.average_exposure) / nullif(f.average_exposure, 0) * 100",
    "exposure_load_change": "m.exposure_load - f.exposure_load",
    "exposure_load_reduction": "f.exposure_load - m.exposure_load",
    "exposure_load_reduction_pct": "(f.exposure_load - m.exposure_load) / nullif(f.exposure_load, 0) * 100",
    "shade_exposure_change": "m.shade_average_exposure - f.shade_average_exposure",
    "shade_exposure_reduction_pct": "(f.shade_average_exposure - m.shade_average_exposure) / nullif(f.shade_average_exposure, 0) * 100",
    "shade_load_change": "m.shade_exposure_load - f.shade_exposure_load",
    "shade_load_reduction_pct": "(f.shade_exposure_load - m.shade_exposure_load) / nullif(f.shade_exposure_load, 0) * 100",
    "green_indicator_change": "m.green_indicator - f.green_indicator",
    "water_access_change": "m.water_access - f.water_access",
}
_COMPARE = _METRICS + ", comp AS (SELECT m.od_id, m.mode, " + ", ".join(f"round({x}, 6) + 0e0 AS {n}" for n, x in _COMPARED.items()) + """, m.distance_m AS dm, f.distance_m AS df
FROM metrics m JOIN metrics f ON f.od_id = m.od_id AND f.mode = 'fastest' WHERE m.mode <> 'fastest')"""


def routed(s, d, od="od_pairs"):
    """(paths, edges), both written: the edges are a view over other tables, and both are read more than once."""
    scratch = Scratch(s, "routes")
    edges = scratch.write(edges_of(s, d))
    return scratch.write(routes.route_bundle(load(s, d, od), edges, NOON, nodes=scratch.write(nodes_of(s, d)))), edges


def paths_of(s, d, od="od_pairs"):
    return routed(s, d, od)[0]


def metrics_of(s, d):
    return routes.route_metrics(*routed(s, d), NOON)


def comparisons_of(s, d):
    """Rounded, so that a sum's last bit does not decide a sign."""
    c = routes.compare_to_fastest(metrics_of(s, d), shade=True)
    return c.select("od_id", "mode", *[r6(F.col(n)).alias(n) for n in _COMPARED], "passes_guard")


@query(_ROUTES + " SELECT od_id, mode, round(cost, 6) AS total_cost FROM total")
def route_costs(s, d):
    return paths_of(s, d).filter("found").select("od_id", "mode", r6(F.col("total_cost")).alias("total_cost"))


@query(_ROUTES + " SELECT od_id, mode, seq, edge_id FROM steps")
def route_paths(s, d):
    return routes.path_rows(paths_of(s, d))


@query(_ROUTES + " SELECT od_id, mode, seq, edge_id FROM steps")
def route_paths_relaxed(s, d):
    """The same paths over the overlay, as for graphs too large to broadcast."""
    scratch = Scratch(s, "routes")
    edges = scratch.write(edges_of(s, d))
    costs = {m: exposure.edge_cost(m, NOON) for m in ("fastest", "balanced", "coolest")}
    return routes.path_rows(shortest_paths(load(s, d, "od_pairs"), edges, costs, max_edges=0, nodes=nodes_of(s, d), block_nodes=512))


@query(_ROUTES + _METRICS + " SELECT od_id, mode, edge_count, " + ", ".join(f"round({n}, 6) AS {n}" for n in _METRIC_NAMES) + ", '12:00' AS scenario FROM metrics")
def route_metrics(s, d):
    return routes.route_metrics(*routed(s, d), NOON, digits=6)


@query(_ROUTES + _COMPARE + " SELECT od_id, mode, " + ", ".join(_COMPARED) + " FROM comp")
def route_comparisons(s, d):
    return comparisons_of(s, d).drop("passes_guard")


@query(_ROUTES + _COMPARE + " SELECT od_id, mode, round(dm, 6) <= round(df, 6) * 1.1e0 AS passes_guard FROM comp")
def detour_guard(s, d):
    m = metrics_of(s, d).withColumn("distance_m", r6(F.col("distance_m")))
    return routes.compare_to_fastest(m, config=DEFAULT.with_(max_extra_distance_ratio=0.1)).select("od_id", "mode", "passes_guard")


@query(_ROUTES + """, g AS (SELECT s.od_id, s.mode, s.seq, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat FROM steps s JOIN road_edges e USING (edge_id)
 JOIN road_nodes a ON a.node_id = e.source JOIN road_nodes b ON b.node_id = e.target),
p AS (SELECT od_id, mode, seq + 1 AS k, blon AS lon, blat AS lat FROM g UNION ALL SELECT od_id, mode, 0, alon, alat FROM g WHERE seq = 0)
SELECT od_id, mode, CAST(k AS INTEGER) AS k, lon, lat FROM p""")
def route_geometry(s, d):
    paths, edges = routed(s, d)
    lines = routes.route_geometry(paths, routes.edge_geometry(edges, nodes_of(s, d)))
    return lines.select("od_id", "mode", F.posexplode("geometry").alias("k", "p")).select("od_id", "mode", "k", "p.lon", "p.lat")


@query()
def shaded_ground(s, d):
    """Ground in the towers' shadows and outside them, by scenario and square; tests hold it against a known shadow and the kernel."""
    selected, sun = _towers(s, d, Scratch(s, "buildings"))
    parts = dissolve.ground_shade(selected, sun)
    return parts.groupBy("scenario", "cx", "cy").agg(F.count("*").alias("n_parts"), r6(F.sum(dissolve.rings_area(F.col("rings"))), 3).alias("area"))


@query(_ROUTES + """, l AS (SELECT t.od_id, t.mode, coalesce(string_agg(edge_id, ',' ORDER BY seq), '') AS p FROM total t LEFT JOIN steps USING (od_id, mode) GROUP BY 1, 2),
w AS (SELECT od_id, max(p) FILTER (mode = 'fastest') AS f, max(p) FILTER (mode = 'balanced') AS b, max(p) FILTER (mode = 'coolest') AS c FROM l GROUP BY 1)
SELECT od_id, f = b AS fastest_equals_balanced, f = c AS fastest_equals_coolest, b = c AS balanced_equals_coolest, f = b AND f = c AS all_equal FROM w""")
def path_equality(s, d):
    return routes.path_equality(paths_of(s, d))


@query(_ROUTES + """, t AS (SELECT od_id, mode, seq - 1 AS seq, edge_id, row_number() OVER (PARTITION BY od_id, mode ORDER BY seq) AS k, count(*) OVER (PARTITION BY od_id, mode) AS n FROM steps),
cut AS (SELECT od_id, mode, seq, edge_id, k, CASE WHEN k >= 3 THEN k - 1 ELSE k END AS j FROM t WHERE k <> 2),
w AS (SELECT c.od_id, c.mode, c.j, c.edge_id, e.source, lag(e.target) OVER (PARTITION BY c.od_id, c.mode ORDER BY c.j) AS prior FROM cut c JOIN road_edges e USING (edge_id))
SELECT od_id, mode, CAST(j - 1 AS INTEGER) AS seq, edge_id FROM w WHERE prior <> source""")
def path_continuity(s, d):
    """Paths that lost their second edge."""
    paths, edges = routed(s, d)
    holed = F.when(F.size("edge_ids") > 1, F.concat(F.slice("edge_ids", 1, 1), F.slice("edge_ids", 3, F.size("edge_ids")))).otherwise(F.col("edge_ids"))
    return routes.continuity_violations(paths.withColumn("edge_ids", holed), edges)


# Quartiles lie halfway between lengths of six decimals, so fewer are compared.
_FIELDS = ["distance_m", "walking_s", "average_exposure", "exposure_load", "green_indicator", "water_access", "edge_count"]


@query(_ROUTES + _METRICS + ", l AS (" + " UNION ALL ".join(f"SELECT mode, '{f}' AS field, CAST({f} AS DOUBLE) AS v FROM metrics" for f in _FIELDS) + """)
SELECT mode, field, count(v) AS n, count(*) - count(v) AS n_null, round(min(v), 4) AS min, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median,
 round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.9), 4) AS p90, round(max(v), 4) AS max FROM l GROUP BY mode, field""")
def metric_distributions(s, d):
    return evaluation.summarize(evaluation.long_form(metrics_of(s, d), ["od_id", "mode"], _FIELDS), "value", ["mode", "field"], 4)


_TESTS = {
    "average_reduced": "a > 0", "load_reduced": "b > 0", "both_reduced": "a > 0 AND b > 0",
    "average_reduced_load_increased": "a > 0 AND b < 0", "neither_reduced": "a <= 0 AND b <= 0",
}
_AB = "SELECT *, average_exposure_reduction AS a, exposure_load_reduction AS b FROM comp"


@query(_ROUTES + _COMPARE + f", q AS ({_AB}) SELECT mode, count(*) AS total, " + ", ".join(f"count(CASE WHEN {t} THEN 1 END) AS {n}" for n, t in _TESTS.items()) + ", "
       + ", ".join(f"count(CASE WHEN {t} THEN 1 END) / CAST(count(*) AS DOUBLE) AS {n}_rate" for n, t in _TESTS.items()) + " FROM q GROUP BY mode")
def improvement_counts(s, d):
    return evaluation.improvements(comparisons_of(s, d))


_T3 = {"average_reduced": "a > 0", "load_reduced": "b > 0", "both_reduced": "a > 0 AND b > 0"}


@query(_ROUTES + _COMPARE + f", q AS ({_AB})," + """ t(field, threshold) AS (VALUES ('extra_distance_pct', 5e0), ('extra_distance_pct', 10e0), ('extra_distance_pct', 15e0), ('extra_distance_pct', 25e0),
 ('extra_walking_min', 1e0), ('extra_walking_min', 3e0), ('extra_walking_min', 5e0)),
x AS (SELECT *, CASE field WHEN 'extra_distance_pct' THEN coalesce(extra_distance_pct, 0) ELSE extra_walking_min END <= threshold AS ok FROM q CROSS JOIN t)
SELECT mode, field, threshold, count(CASE WHEN ok THEN 1 END) AS eligible, count(CASE WHEN ok THEN 1 END) / CAST(count(*) AS DOUBLE) AS eligible_rate, """
       + ", ".join(f"count(CASE WHEN ok AND {t} THEN 1 END) AS {n}, count(CASE WHEN ok AND {t} THEN 1 END) / nullif(CAST(count(CASE WHEN ok THEN 1 END) AS DOUBLE), 0) AS {n}_rate" for n, t in _T3.items()) + " FROM x GROUP BY mode, field, threshold")
def threshold_sweep(s, d):
    return evaluation.threshold_sweep(comparisons_of(s, d))


@query(_ROUTES + _METRICS + """, c AS (SELECT CASE WHEN d >= 400 AND d < 1000 THEN 'short' WHEN d >= 1000 AND d < 2000 THEN 'medium' WHEN d >= 2000 AND d <= 3500 THEN 'long' END AS stratum
 FROM (SELECT round(distance_m, 6) AS d FROM metrics WHERE mode = 'fastest')) SELECT s.stratum, count(c.stratum) AS n FROM (SELECT unnest(['short', 'medium', 'long']) AS stratum) s LEFT JOIN c USING (stratum) GROUP BY 1""")
def strata_counts(s, d):
    m = metrics_of(s, d).filter("mode = 'fastest'").select(r6(F.col("distance_m")).alias("distance_m"))
    return evaluation.strata_counts(m, "distance_m")


@query(with_views("road_nodes", "road_edges", "station_trips") + ", od_pairs AS (SELECT * FROM station_trips), " + _PATHS + """, k AS (SELECT od_id, mode, count(*) AS n FROM steps GROUP BY 1, 2)
SELECT od_id, mode, true AS found, round(cost, 6) AS total_cost, CAST(coalesce(n, 0) AS INTEGER) AS n_edges FROM total LEFT JOIN k USING (od_id, mode)""")
def station_trip_costs(s, d):
    """All modes for a trip from every station: the throughput query."""
    return paths_of(s, d, "station_trips").select("od_id", "mode", "found", r6(F.col("total_cost")).alias("total_cost"), F.size("edge_ids").alias("n_edges"))


@query(with_views("road_edges", "od_pairs") + f""", es AS MATERIALIZED (SELECT source, target, length AS cost FROM road_edges), start AS MATERIALIZED (SELECT DISTINCT source FROM od_pairs),
r(src, n, cost) USING KEY (src, n) AS (SELECT source, source, 0e0 FROM start UNION
  SELECT r.src, e.target, min(r.cost + e.cost) FROM r JOIN es e ON e.source = r.n LEFT JOIN recurring.r AS p ON p.src = r.src AND p.n = e.target
  WHERE p.cost IS NULL OR r.cost + e.cost < p.cost GROUP BY r.src, e.target)
SELECT src AS source, count(*) AS n_reached, round(max(cost), 6) AS farthest, round(avg(cost), 6) AS mean FROM r GROUP BY src""")
def reachable_tree(s, d):
    """Trees of all od_pairs' sources: a task searches a tree over the broadcast graph, or costs go from tile to tile where it is too large for that."""
    tree = tree_costs(edges_of(s, d), load(s, d, "od_pairs"), "length", nodes=nodes_of(s, d))
    return tree.groupBy("source").agg(F.count(F.lit(1)).alias("n_reached"), r6(F.max("cost")).alias("farthest"), r6(F.avg("cost")).alias("mean"))


# -- components -------------------------------------------------------------------------

def _split_edges(s, d):
    """The network without the edges across every tenth row and column: many components."""
    n = nodes_of(s, d)
    c = n.select("node_id", F.round((F.col("lon") - 139.6) * 1000).cast("long").alias("c"), F.round((F.col("lat") - 35.55) * 1000).cast("long").alias("r"))
    a, b = c.alias("a"), c.alias("b")
    e = edges_of(s, d).join(a, F.col("source") == F.col("a.node_id")).join(b, F.col("target") == F.col("b.node_id"))
    same = lambda x: F.floor(F.col(f"a.{x}") / 10) == F.floor(F.col(f"b.{x}") / 10)
    return e.filter(same("c") & same("r")).select(*edges_of(s, d).columns)


_SPLIT = """, nc AS (SELECT node_id, CAST(round((lon - 139.6e0) * 1000) AS BIGINT) AS c, CAST(round((lat - 35.55e0) * 1000) AS BIGINT) AS r FROM road_nodes),
se AS MATERIALIZED (SELECT e.* FROM road_edges e JOIN nc a ON a.node_id = source JOIN nc b ON b.node_id = target WHERE a.c // 10 = b.c // 10 AND a.r // 10 = b.r // 10),
comp AS MATERIALIZED (SELECT node_id AS node, min(node_id) OVER (PARTITION BY c // 10, r // 10) AS component FROM nc)"""


@query(with_views("road_nodes", "road_edges") + _SPLIT + " SELECT node, component FROM comp")
def weak_components(s, d):
    return repair.weak_components(nodes_of(s, d), _split_edges(s, d))


@query(with_views("road_nodes", "road_edges") + _SPLIT + " SELECT component, count(*) AS n_nodes FROM comp GROUP BY 1")
def component_sizes(s, d):
    return components.component_sizes(repair.weak_components(nodes_of(s, d), _split_edges(s, d)))


@query(with_views("road_nodes", "road_edges") + _SPLIT + " SELECT node, component FROM comp WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 25)")
def retained_components(s, d):
    return repair.keep_components(repair.weak_components(nodes_of(s, d), _split_edges(s, d)))


def _pairs(s, d):
    """Grid cells a little wider than the network's spacing, so that rounding puts neighbours together."""
    n = nodes_of(s, d)
    return spatial.nearest_component_pairs(n, repair.weak_components(n, _split_edges(s, d)), 0.0015)


_NEAR = f""", pl AS MATERIALIZED (SELECT n.node_id, component, lon, lat, floor(lon / 0.0015e0) AS cx, floor(lat / 0.0015e0) AS cy FROM road_nodes n JOIN comp ON node = node_id),
pr AS (SELECT a.component AS comp_a, b.component AS comp_b, a.node_id AS node_a, b.node_id AS node_b, {haversine_sql('a.', 'b.')} AS length FROM pl a JOIN pl b
 ON b.cx BETWEEN a.cx - 1 AND a.cx + 1 AND b.cy BETWEEN a.cy - 1 AND a.cy + 1 AND a.component < b.component),
best AS MATERIALIZED (SELECT comp_a, comp_b, min(length) AS length FROM pr GROUP BY 1, 2)"""


@query(with_views("road_nodes", "road_edges") + _SPLIT + _NEAR + " SELECT comp_a, comp_b, round(length, 4) AS length FROM best")
def nearest_component_pairs(s, d):
    return _pairs(s, d).select("comp_a", "comp_b", r6(F.col("length"), 4).alias("length"))


@query()
def mst_bridges(s, d):
    return repair.spanning_bridges(_pairs(s, d)).select("comp_a", "comp_b", "node_a", "node_b", r6(F.col("length"), 4).alias("length"))


_END = ", ".join(f"round(least(1e0, greatest(0e0, (x.{c} + y.{c}) / 2)), 10) AS {c}" for c in repair.ENVIRONMENT)


@query(with_views("road_nodes", "road_edges") + """, inc AS (SELECT source AS node, * FROM road_edges UNION ALL SELECT target AS node, * FROM road_edges WHERE source <> target),
mean AS MATERIALIZED (SELECT node, """ + ", ".join(f"avg({c}) AS {c}" for c in repair.ENVIRONMENT) + f""" FROM inc GROUP BY 1),
b AS (SELECT s_suppkey AS bridge, s_suppkey AS node_a, s_suppkey + 1 AS node_b FROM supplier)
SELECT bridge, {_END} FROM b JOIN mean x ON x.node = node_a JOIN mean y ON y.node = node_b""")
def bridge_environment(s, d):
    """One bridge for each supplier, between the nodes of its number and the next."""
    k = F.col("s_suppkey").cast("long")
    b = load(s, d, "supplier").select(k.alias("bridge"), k.alias("node_a"), (k + 1).alias("node_b"))
    out = repair.bridge_environment(b, edges_of(s, d))
    return out.select("bridge", *[r6(F.col(c), 10).alias(c) for c in repair.ENVIRONMENT])


@query(with_views("road_edges") + " SELECT edge_id, CASE WHEN source % 3 <> 0 THEN length ELSE length + 1 END AS length FROM road_edges")
def keyed_union(s, d):
    """Two overlapping tables whose lengths differ; the first one's stay."""
    e = edges_of(s, d).select("edge_id", "length", "source")
    parts = [e.filter(F.col("source") % 3 != k).select("edge_id", (F.col("length") + F.lit(float(k))).alias("length")) for k in (0, 1)]
    return repair.union_graphs(parts, ["edge_id"])


# -- sampling ---------------------------------------------------------------------------

@query("""WITH RECURSIVE l(n, state) AS (SELECT 1, (1664525 * 20260821::BIGINT + 1013904223) % 4294967296 UNION ALL SELECT n + 1, (1664525 * state + 1013904223) % 4294967296 FROM l WHERE n < (SELECT count(*) FROM customer))
SELECT CAST(n AS BIGINT) AS n, state, state / 4294967296e0 AS value FROM l""")
def lcg_sequence(s, d):
    """As many draws as there are customers."""
    return evaluation.lcg_sequence(s, load(s, d, "customer").count())


@query(with_views("road_nodes") + f""", l(n, state) AS (SELECT 1, (1664525 * 20260821::BIGINT + 1013904223) % 4294967296 UNION ALL SELECT n + 1, (1664525 * state + 1013904223) % 4294967296 FROM l WHERE n < 2 * (SELECT count(*) FROM customer)),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY CAST(node_id AS VARCHAR)) - 1 AS k, * FROM road_nodes),
dr AS MATERIALIZED (SELECT n, CAST(floor(state / 4294967296e0 * (SELECT count(*) FROM o)) AS BIGINT) AS k FROM l),
p AS (SELECT (x.n + 1) // 2 AS attempt, a.node_id AS source, b.node_id AS target, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat
 FROM dr x JOIN dr y ON x.n % 2 = 1 AND y.n = x.n + 1 JOIN o a ON a.k = x.k JOIN o b ON b.k = y.k),
m AS (SELECT attempt, source, target, {equirect_sql('a', 'b')} AS straight_m FROM p)
SELECT CAST(attempt AS BIGINT) AS attempt, source, target, round(straight_m, 4) AS straight_m, CASE WHEN source = target THEN 'same_node' WHEN straight_m < 350 OR straight_m > 1800 THEN 'straight_distance' END AS reason FROM m""")
def od_attempts(s, d):
    a = evaluation.draw_attempts(nodes_of(s, d), load(s, d, "customer").count())
    return a.select("attempt", "source", "target", r6(F.col("straight_m"), 4).alias("straight_m"), evaluation.first_reason().alias("reason"))


# Draws double in number with every step of l; 3,000 attempts fill the strata of a network of 2,000 nodes, smaller ones need more.
_SAMPLE = with_views("road_nodes", "road_edges") + f""", l(k, n, state, a, c) AS (SELECT 0, 1::BIGINT, (1664525 * 20260821::HUGEINT + 1013904223) % 4294967296, 1664525::HUGEINT, 1013904223::HUGEINT
 UNION ALL SELECT k + 1, n + u * (1::BIGINT << k), CASE WHEN u = 0 THEN state ELSE (a * state + c) % 4294967296 END, a * a % 4294967296, (a * c + c) % 4294967296 FROM l CROSS JOIN (VALUES (0), (1)) t(u) WHERE k < 18),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY CAST(node_id AS VARCHAR)) - 1 AS k, * FROM road_nodes),
dr AS MATERIALIZED (SELECT n, CAST(floor(state / 4294967296e0 * (SELECT count(*) FROM o)) AS BIGINT) AS k FROM l WHERE k = 18 AND n <= 2 * (SELECT CASE WHEN count(*) <= 500 THEN 100000 ELSE 3000 END FROM o)),
p AS (SELECT (x.n + 1) // 2 AS attempt, a.node_id AS source, b.node_id AS target, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat
 FROM dr x JOIN dr y ON x.n % 2 = 1 AND y.n = x.n + 1 JOIN o a ON a.k = x.k JOIN o b ON b.k = y.k),
m0 AS (SELECT attempt, source, target, {equirect_sql('a', 'b')} AS straight_m FROM p),
m AS MATERIALIZED (SELECT *, CASE WHEN source = target THEN 'same_node' WHEN straight_m < 350 OR straight_m > 1800 THEN 'straight_distance' END AS early FROM m0),
es AS MATERIALIZED (SELECT source, target, min(length) AS cost FROM road_edges GROUP BY 1, 2), start AS MATERIALIZED (SELECT DISTINCT source FROM m WHERE early IS NULL),
r(src, n, cost) USING KEY (src, n) AS (SELECT source, source, 0e0 FROM start UNION
  SELECT r.src, e.target, min(r.cost + e.cost) FROM r JOIN es e ON e.source = r.n LEFT JOIN recurring.r AS q ON q.src = r.src AND q.n = e.target
  WHERE q.cost IS NULL OR r.cost + e.cost < q.cost GROUP BY r.src, e.target),
f0 AS (SELECT m.*, CASE WHEN early IS NULL THEN r.cost END AS fastest_m FROM m LEFT JOIN r ON r.src = m.source AND r.n = m.target),
f1 AS (SELECT *, CASE WHEN fastest_m >= 400 AND fastest_m < 1000 THEN 'short' WHEN fastest_m >= 1000 AND fastest_m < 2000 THEN 'medium' WHEN fastest_m >= 2000 AND fastest_m <= 3500 THEN 'long' END AS stratum FROM f0),
f2 AS (SELECT *, coalesce(early, CASE WHEN fastest_m IS NULL THEN 'route_failed' WHEN stratum IS NULL THEN 'fastest_distance' WHEN fastest_m / straight_m > 3 THEN 'ratio' END) AS late FROM f1),
f3 AS (SELECT *, late IS NULL AND row_number() OVER (PARTITION BY source, target, late IS NULL ORDER BY attempt) > 1 AS again FROM f2),
f4 AS MATERIALIZED (SELECT *, CASE WHEN late IS NULL AND NOT again THEN row_number() OVER (PARTITION BY stratum, late IS NULL AND NOT again ORDER BY attempt) END AS place FROM f3),
taken AS MATERIALIZED (SELECT DISTINCT source, target FROM f4 WHERE place <= 30),
sample AS (SELECT f4.*, CASE WHEN place <= 30 THEN NULL WHEN late IS NOT NULL THEN late WHEN again AND t.source IS NOT NULL THEN 'duplicate_pair' ELSE 'stratum_full' END AS reason
 FROM f4 LEFT JOIN taken t ON t.source = f4.source AND t.target = f4.target WHERE attempt <= (SELECT max(attempt) FROM f4 WHERE place <= 30))"""


def _sample(s, d):
    """The model's limit of attempts suits one city: pairs within reach thin out as the network grows, so more nodes allow more attempts."""
    attempts = max(evaluation.MAX_ATTEMPTS, 10 * load(s, d, "part").count())  # a node for each part
    return evaluation.sample_pairs(nodes_of(s, d), edges_of(s, d), attempts=attempts)


@query(_SAMPLE + " SELECT CAST(attempt AS BIGINT) AS attempt, source, target, stratum, round(fastest_m, 6) AS fastest_m FROM sample WHERE reason IS NULL")
def od_sample(s, d):
    return _sample(s, d).filter("reason is null").select("attempt", "source", "target", "stratum", r6(F.col("fastest_m")).alias("fastest_m"))


@query(_SAMPLE + f" SELECT reason, count(sample.reason) AS n FROM (SELECT unnest({list(evaluation.REASONS)!r}) AS reason) LEFT JOIN sample USING (reason) GROUP BY reason")
def rejection_counts(s, d):
    return evaluation.rejection_counts(_sample(s, d))


# -- sun and shadow ---------------------------------------------------------------------

def _sun(s, d):
    p = nodes_of(s, d).crossJoin(F.broadcast(solar.scenarios(s)))  # three scenarios
    az, el = solar.solar_position(F.unix_timestamp("instant").cast("double"), F.col("lat"), F.col("lon"))
    return p.select("node_id", "scenario", az.alias("azimuth"), el.alias("elevation"), "lon", "lat")


_SUN = """, sc(scenario, u) AS (VALUES ('09:00', 1790121600e0), ('12:00', 1790132400e0), ('15:00', 1790143200e0)),
t AS (SELECT *, (u / 86400 + 2440587.5 - 2451545) / 36525 AS t FROM road_nodes CROSS JOIN sc),
a AS (SELECT *, (280.46646e0 + t * (36000.76983e0 + t * 0.0003032e0)) - floor((280.46646e0 + t * (36000.76983e0 + t * 0.0003032e0)) / 360) * 360 AS ml,
 radians(357.52911e0 + t * (35999.05029e0 - 0.0001537e0 * t)) AS ma, 0.016708634e0 - t * (0.000042037e0 + 0.0000001267e0 * t) AS ec, radians(125.04e0 - 1934.136e0 * t) AS om FROM t),
b AS (SELECT *, radians(ml + sin(ma) * (1.914602e0 - t * (0.004817e0 + 0.000014e0 * t)) + sin(2 * ma) * (0.019993e0 - 0.000101e0 * t) + sin(3 * ma) * 0.000289e0 - 0.00569e0 - 0.00478e0 * sin(om)) AS ap,
 radians(23 + (26 + (21.448e0 - t * (46.815e0 + t * (0.00059e0 - t * 0.001813e0))) / 60) / 60 + 0.00256e0 * cos(om)) AS ob FROM a),
c AS (SELECT *, asin(sin(ob) * sin(ap)) AS de, tan(ob / 2) * tan(ob / 2) AS y, radians(ml) AS lr FROM b),
e AS (SELECT *, 4 * degrees(y * sin(2 * lr) - 2 * ec * sin(ma) + 4 * ec * y * sin(ma) * cos(2 * lr) - 0.5e0 * y * y * sin(4 * lr) - 1.25e0 * ec * ec * sin(2 * ma)) AS eq, (u - floor(u / 86400) * 86400) / 60 AS mi FROM c),
f AS (SELECT *, (mi + eq + 4 * lon) - floor((mi + eq + 4 * lon) / 1440) * 1440 AS ts, radians(lat) AS ph FROM e), g AS (SELECT *, radians(ts / 4 - 180) AS h FROM f),
sun AS (SELECT node_id, scenario, lon, lat, degrees(atan2(sin(h), cos(h) * sin(ph) - tan(de) * cos(ph))) + 180 AS azimuth,
 90 - degrees(acos(greatest(-1e0, least(1e0, sin(ph) * sin(de) + cos(ph) * cos(de) * cos(h))))) AS elevation FROM g)"""


@query(with_views("road_nodes") + _SUN + " SELECT node_id, scenario, round(azimuth, 4) AS azimuth, round(elevation, 4) AS elevation FROM sun")
def solar_positions(s, d):
    return _sun(s, d).select("node_id", "scenario", r6(F.col("azimuth"), 4).alias("azimuth"), r6(F.col("elevation"), 4).alias("elevation"))


@query(with_views("road_nodes") + _SUN + """, v AS (SELECT *, (5 + node_id % 40) / tan(radians(elevation)) AS r FROM sun)
SELECT node_id, scenario, round(-r * sin(radians(azimuth)), 3) AS dx, round(-r * cos(radians(azimuth)), 3) AS dy FROM v""")
def shadow_vertices(s, d):
    """Shadow of a mast on every node, as an offset in metres."""
    z, o = (F.lit(5) + F.col("node_id") % 40).cast("double"), F.lit(0.0)
    v = _sun(s, d).withColumn("p", solar.project_vertex(o, o, z, o, F.col("azimuth"), F.col("elevation")))
    return v.select("node_id", "scenario", r6(F.col("p.x"), 3).alias("dx"), r6(F.col("p.y"), 3).alias("dy"))


# -- display, state, resume -------------------------------------------------------------

@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity * 97.5e0 AS m, (l_quantity - 25) * 11e0 AS s, CAST(l_discount * 100 - 5 AS DOUBLE) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber,
 CASE WHEN m < 1000 THEN concat(CAST(CAST(floor(m + 0.5) AS BIGINT) AS VARCHAR), ' m') ELSE concat(regexp_replace(regexp_replace(CASE WHEN m / 1000 >= 10 THEN printf('%.1f', m / 1000) ELSE printf('%.2f', m / 1000) END, '\\.0+$', ''), '(\\.[0-9])0$', '\\1'), ' km') END AS distance,
 concat(CAST(CAST(ceil(m / 1.4 / 60) AS BIGINT) AS VARCHAR), '分') AS walking,
 concat(CASE WHEN s < 0 THEN '−' ELSE '+' END, CASE WHEN abs(s) < 60 THEN concat(CAST(CAST(floor(abs(s) + 0.5) AS BIGINT) AS VARCHAR), '秒') ELSE concat(CAST(CAST(ceil(abs(s) / 60) AS BIGINT) AS VARCHAR), '分') END) AS extra,
 concat(CASE WHEN round(p, 4) > 0 THEN '+' WHEN round(p, 4) < 0 THEN '−' ELSE '' END, CAST(CAST(floor(abs(round(p, 4)) + 0.5) AS BIGINT) AS VARCHAR), '%') AS pct FROM v""")
def display_formats(s, d):
    m, sec = F.col("l_quantity") * F.lit(97.5), (F.col("l_quantity") - 25) * F.lit(11.0)
    p = F.round((F.col("l_discount") * 100 - 5).cast("double"), 4)
    return load(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", compare.format_distance(m.cast("double")).alias("distance"), compare.format_walking_time((m / 1.4).cast("double")).alias("walking"),
        compare.format_extra_time(sec.cast("double")).alias("extra"), compare.format_percent(p, signed=True).alias("pct"),
    )


@query(with_views("ui_events") + """, ev AS MATERIALIZED (SELECT session_id, event_id, action, mode, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS k FROM ui_events),
f(session_id, k, phase, start, destination, route, selected_mode, error) AS (
 SELECT DISTINCT session_id, CAST(0 AS BIGINT), 'awaiting-start', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'balanced', CAST(NULL AS VARCHAR) FROM ev
 UNION ALL SELECT f.session_id, ev.k,
  CASE WHEN action = 'MAP_CLICK' AND phase = 'awaiting-start' THEN 'awaiting-destination' WHEN action = 'MAP_CLICK' THEN 'route-ready'
   WHEN action = 'SELECT_START_REQUESTED' AND phase = 'route-ready' THEN 'selecting-start' WHEN action = 'SELECT_DESTINATION_REQUESTED' AND phase = 'route-ready' THEN 'selecting-destination' ELSE phase END,
  CASE WHEN action = 'MAP_CLICK' AND phase IN ('awaiting-start', 'selecting-start') THEN CAST(event_id AS VARCHAR) ELSE start END,
  CASE WHEN action = 'MAP_CLICK' AND phase IN ('awaiting-destination', 'selecting-destination') THEN CAST(event_id AS VARCHAR) ELSE destination END,
  CASE WHEN action = 'MAP_CLICK' AND phase IN ('awaiting-destination', 'selecting-start', 'selecting-destination') THEN concat('route-', event_id) ELSE route END,
  CASE WHEN action = 'ROUTE_MODE_SELECTED' THEN mode ELSE selected_mode END,
  CASE WHEN action = 'CANDIDATE_REJECTED' THEN 'rejected' WHEN action = 'ROUTE_MODE_SELECTED' THEN NULL WHEN action = 'MAP_CLICK' AND phase <> 'route-ready' THEN NULL
   WHEN action LIKE 'SELECT%' AND phase = 'route-ready' THEN NULL ELSE error END
 FROM f JOIN ev ON ev.session_id = f.session_id AND ev.k = f.k + 1)
SELECT session_id, phase, start, destination, route, selected_mode, error, k AS n_events FROM f QUALIFY k = max(k) OVER (PARTITION BY session_id)""")
def selection_states(s, d):
    """The state of every session after its last event."""
    return state.fold_sessions(load(s, d, "ui_events"))


@query("""WITH u AS (SELECT DISTINCT o_orderdate AS day, CAST(o_orderdate AS VARCHAR) AS unit_id FROM orders), done AS (SELECT unit_id FROM u WHERE extract(day FROM day) <= 10), failed AS (SELECT unit_id FROM u WHERE extract(day FROM day) = 11)
SELECT unit_id, CASE WHEN unit_id IN (SELECT unit_id FROM failed) THEN 'failed' ELSE 'new' END AS status FROM u WHERE unit_id NOT IN (SELECT unit_id FROM done)""")
def pending_units(s, d):
    """Order days as units: those up to the tenth of a month are done, the eleventh failed."""
    u = load(s, d, "orders").select(F.col("o_orderdate").alias("day"), F.col("o_orderdate").cast("string").alias("unit_id")).distinct()
    day = F.dayofmonth("day")
    progress = u.filter(day <= 11).select("unit_id", F.when(day <= 10, "completed").otherwise("failed").alias("status"))
    shards = u.filter(day <= 10).select("unit_id")
    return state.pending_units(u.select("unit_id"), progress, shards)


@query("SELECT user_id AS session_id, arg_max(event_id, struct_pack(ts := ts, e := event_id)) AS latest FROM events GROUP BY user_id")
def latest_requests(s, d):
    """The newest request of each session; older answers are stale."""
    return state.latest(load(s, d, "ui_events"), "session_id", ["ts", "event_id"]).select("session_id", F.col("event_id").alias("latest"))


@query(with_views("stations") + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null FROM stations" for c in ("station_id", "lon", "lat", "name", "location")))
def column_nulls(s, d):
    return graph_json.inspect_columns(load(s, d, "stations"))


# -- planar joins -----------------------------------------------------------------------

def _xy(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def _square(x, y, dx, dy):
    """A one-ring polygon around a point."""
    w, e, so, n = x - F.lit(dx), x + F.lit(dx), y - F.lit(dy), y + F.lit(dy)
    return F.array(F.array(_xy(w, so), _xy(e, so), _xy(e, n), _xy(w, n)))


def _degree_lines(s, d):
    """Edges as two-point lines in the plane of degrees, where they are parallel to the axes."""
    return _ends(s, d).select("edge_id", F.array(_xy(F.col("a.lon"), F.col("a.lat")), _xy(F.col("b.lon"), F.col("b.lat"))).alias("line"))


def _blocks(s, d):
    return load(s, d, "stations").select(F.col("station_id").cast("long").alias("poly_id"), _square(F.col("lon"), F.col("lat"), 0.00063, 0.00047).alias("rings"))


_BLOCKS = ", b AS (SELECT station_id AS poly_id, lon - 0.00063e0 AS w, lat - 0.00047e0 AS s, lon + 0.00063e0 AS e, lat + 0.00047e0 AS n FROM stations)"


@query(with_views("road_nodes", "road_edges", "stations") + _ENDS + _BLOCKS + """,
h AS (SELECT edge_id, poly_id, abs(CASE WHEN blon > alon THEN greatest(w, alon) ELSE least(e, alon) END - alon) AS s, abs(CASE WHEN blon > alon THEN least(e, blon) ELSE greatest(w, blon) END - alon) AS e
  FROM ends JOIN b ON abs(alat - blat) < 1e-9 AND alat > s AND alat < n AND least(alon, blon) < e AND greatest(alon, blon) > w),
v AS (SELECT edge_id, poly_id, abs(CASE WHEN blat > alat THEN greatest(b.s, alat) ELSE least(b.n, alat) END - alat) AS s, abs(CASE WHEN blat > alat THEN least(b.n, blat) ELSE greatest(b.s, blat) END - alat) AS e
  FROM ends JOIN b ON abs(alon - blon) < 1e-9 AND alon > b.w AND alon < b.e AND least(alat, blat) < b.n AND greatest(alat, blat) > b.s)
SELECT edge_id, poly_id, round(s, 8) AS s, round(e, 8) AS e FROM (SELECT * FROM h UNION ALL SELECT * FROM v)""")
def line_polygon_intervals(s, d):
    """Where the edges run under the block around each station."""
    out = cover.line_polygon_intervals(_degree_lines(s, d), _blocks(s, d), ["poly_id"], 0.001)
    return out.select("edge_id", "poly_id", r6(F.col("s"), 8).alias("s"), r6(F.col("e"), 8).alias("e"))


@query(with_views("road_nodes", "road_edges", "stations") + _ENDS + _BLOCKS + """,
h AS (SELECT edge_id, poly_id, abs(CASE WHEN blon > alon THEN greatest(w, alon) ELSE least(e, alon) END - alon) AS s, abs(CASE WHEN blon > alon THEN least(e, blon) ELSE greatest(w, blon) END - alon) AS e
  FROM ends JOIN b ON abs(alat - blat) < 1e-9 AND alat > s AND alat < n AND least(alon, blon) < e AND greatest(alon, blon) > w),
v AS (SELECT edge_id, poly_id, abs(CASE WHEN blat > alat THEN greatest(b.s, alat) ELSE least(b.n, alat) END - alat) AS s, abs(CASE WHEN blat > alat THEN least(b.n, blat) ELSE greatest(b.s, blat) END - alat) AS e
  FROM ends JOIN b ON abs(alon - blon) < 1e-9 AND alon > b.w AND alon < b.e AND least(alat, blat) < b.n AND greatest(alat, blat) > b.s)
SELECT edge_id, poly_id, round(s, 8) AS s, round(e, 8) AS e FROM (SELECT * FROM h UNION ALL SELECT * FROM v)""")
def interval_table_function(s, d):
    """The same intervals by the table function in a lateral join, over the pairs whose boxes meet."""
    extensions.register(s)
    lines = _degree_lines(s, d).select("edge_id", "line", spatial.line_box(F.col("line")).alias("box"))
    blocks = _blocks(s, d).select("poly_id", "rings", cover.rings_box(F.col("rings")).alias("box"))
    pairs = spatial.box_pairs(lines, blocks, 0.001).select("l.edge_id", "l.line", "r.poly_id", "r.rings")
    return s.sql("SELECT edge_id, poly_id, round(i.s, 8) AS s, round(i.e, 8) AS e FROM {pairs}, LATERAL line_intervals(line, rings) i", pairs=pairs)


@query(with_views("stations") + _BLOCKS + """, c AS (SELECT *, unnest(generate_series(CAST(floor(w / 0.001e0) AS BIGINT), CAST(floor(e / 0.001e0) AS BIGINT))) AS cx FROM b),
f AS (SELECT *, unnest(generate_series(CAST(floor(s / 0.001e0) AS BIGINT), CAST(floor(n / 0.001e0) AS BIGINT))) AS cy FROM c)
SELECT poly_id, cx, cy, round((least(e, (cx + 1) * 0.001e0) - greatest(w, cx * 0.001e0)) * (least(n, (cy + 1) * 0.001e0) - greatest(s, cy * 0.001e0)) * 1e6, 4) AS area FROM f""")
def tile_fragments(s, d):
    out = cover.fragments(_blocks(s, d), 0.001)
    return out.select("poly_id", "cx", "cy", r6(F.col("area") * 1e6, 4).alias("area"))


def _squares_sql(layers: dict[str, str], kept: str) -> str:
    """CTEs that cut boxes to squares and their planes to cells; the area of the cells that ``kept`` holds, by square."""
    ctes = "".join(f""",
{k}c AS (SELECT *, unnest(generate_series(CAST(floor(w / 0.001e0) AS BIGINT), CAST(floor(e / 0.001e0) AS BIGINT))) AS cx FROM ({boxes})),
{k}f AS (SELECT *, unnest(generate_series(CAST(floor(s / 0.001e0) AS BIGINT), CAST(floor(n / 0.001e0) AS BIGINT))) AS cy FROM {k}c),
{k} AS (SELECT cx, cy, greatest(w, cx * 0.001e0) AS w, least(e, (cx + 1) * 0.001e0) AS e, greatest(s, cy * 0.001e0) AS s, least(n, (cy + 1) * 0.001e0) AS n FROM {k}f)""" for k, boxes in layers.items())
    ends = lambda a, b: " UNION ".join(f"SELECT cx, cy, {c} AS v FROM {k}" for k in layers for c in (a, b))
    return ctes + f""",
xs AS (SELECT cx, cy, v AS x, lead(v) OVER (PARTITION BY cx, cy ORDER BY v) AS x2 FROM ({ends("w", "e")})),
ys AS (SELECT cx, cy, v AS y, lead(v) OVER (PARTITION BY cx, cy ORDER BY v) AS y2 FROM ({ends("s", "n")})),
z AS (SELECT xs.cx, xs.cy, (x + x2) / 2 AS mx, (y + y2) / 2 AS my, (x2 - x) * (y2 - y) * 1e6 AS area FROM xs JOIN ys USING (cx, cy) WHERE x2 > x AND y2 > y)
SELECT cx, cy, round(sum(area), 4) AS area FROM z WHERE {kept} GROUP BY 1, 2 HAVING round(sum(area), 4) > 0"""


def _within_sql(layer: str) -> str:
    return f"EXISTS (SELECT 1 FROM {layer} q WHERE q.cx = z.cx AND q.cy = z.cy AND mx > w AND mx < e AND my > s AND my < n)"


def _by_square(parts):
    area = r6(F.sum(dissolve.rings_area(F.col("rings"))) * 1e6, 4)
    return parts.groupBy("cx", "cy").agg(area.alias("area")).filter("area > 0")


@query(with_views("stations") + _BLOCKS + _squares_sql({"p": "SELECT w, s, e, n FROM b"}, _within_sql("p")))
def dissolved_blocks(s, d):
    """The union of the blocks around all stations, by square."""
    return _by_square(dissolve.dissolve(_blocks(s, d), [], 0.001))


_SHIFTED = "SELECT lon + 0.0001e0 AS w, lat - 0.0002e0 AS s, lon + 0.0011e0 AS e, lat + 0.0009e0 AS n FROM stations"


@query(with_views("stations") + _BLOCKS + _squares_sql({"p": "SELECT w, s, e, n FROM b", "g": _SHIFTED}, _within_sql("p") + " AND NOT " + _within_sql("g")))
def blocks_outside_parks(s, d):
    """The same less the union of parks beside the stations, which cut blocks to pieces and fill some squares."""
    parks = load(s, d, "stations").select(_square(F.col("lon") + 0.0006, F.col("lat") + 0.00035, 0.0005, 0.00055).alias("rings"))
    return _by_square(dissolve.overlay(_blocks(s, d), parks, [], dissolve.difference, 0.001))


@query(with_views("stations") + """, k AS (SELECT station_id AS poly_id, station_id % 5 AS kind FROM stations)
SELECT poly_id, CAST(CASE kind WHEN 1 THEN 2 WHEN 3 THEN 4 ELSE 1 END AS BIGINT) AS n_parts, CAST(CASE WHEN kind = 2 THEN 1 ELSE 0 END AS BIGINT) AS n_holes,
 CASE kind WHEN 1 THEN 5000e0 WHEN 2 THEN 9750e0 WHEN 3 THEN 5000e0 ELSE 10000e0 END AS area, kind <> 0 AS repaired FROM k WHERE kind <> 4""")
def repaired_outlines(s, d):
    """Outlines as surveys give them: sound, crossing themselves, with a hole that a second ring fills in part, touched at all sides, and drawn twice over."""
    st = spatial.with_projection(load(s, d, "stations")).withColumn("kind", F.col("station_id") % 5)
    at = lambda *points: F.array(*[_xy(F.round("x", 3) + F.lit(float(dx)), F.round("y", 3) + F.lit(float(dy))) for dx, dy in points])
    square = at((0, 0), (100, 0), (100, 100), (0, 100))
    twisted = at((0, 0), (100, 100), (100, 0), (0, 100))
    # What the second ring covers of the hole, 750 of 1,000, is filled again.
    crossed = F.array(square, at((20, 20), (60, 20), (60, 45), (20, 45)), at((40, 20), (60, 20), (60, 45), (20, 45), (20, 32.5), (40, 32.5)))
    touched = F.array(square, at((50, 0), (100, 50), (50, 100), (0, 50)))
    kinds = F.when(F.col("kind") == 0, F.array(square)).when(F.col("kind") == 1, F.array(twisted)).when(F.col("kind") == 2, crossed).when(F.col("kind") == 3, touched).otherwise(F.array(square, square))
    parts = dissolve.repair(st.select(F.col("station_id").cast("long").alias("poly_id"), kinds.alias("rings")))
    area = r6(F.sum(dissolve.rings_area(F.col("rings"))), 3)
    holes = F.sum(F.size("rings") - 1)
    return parts.groupBy("poly_id").agg(F.count("*").alias("n_parts"), holes.alias("n_holes"), area.alias("area"), F.first("repaired").alias("repaired"))


def _metric_lines(s, d):
    n = spatial.with_projection(nodes_of(s, d)).select("node_id", "x", "y")  # a node once, not once for each of its edges
    a, b = n.alias("a"), n.alias("b")
    ends = edges_of(s, d).join(a, F.col("source") == F.col("a.node_id")).join(b, F.col("target") == F.col("b.node_id"))
    return ends.select("edge_id", F.array(_xy(F.col("a.x"), F.col("a.y")), _xy(F.col("b.x"), F.col("b.y"))).alias("line"))


@query()
def green_scores(s, d):
    """Share of each edge's buffer under the green blocks around stations; tests hold the kernel against known areas."""
    p = spatial.with_projection(load(s, d, "stations")).select(F.col("station_id").cast("long").alias("poly_id"), _square(F.col("x"), F.col("y"), 60.0, 45.0).alias("rings"))
    return cover.green_scores(_metric_lines(s, d), p).select("edge_id", r6(F.col("green_score")).alias("green_score"))


def _towers(s, d, scratch):
    """``(selected, sun)``: a tower at every station, and the sun of each scenario."""
    st = spatial.with_projection(load(s, d, "stations")).withColumn("top", (F.lit(10) + F.col("station_id") % 50).cast("double"))
    corner = lambda dx, dy, z: F.struct((F.col("x") + F.lit(dx)).alias("x"), (F.col("y") + F.lit(dy)).alias("y"), z.alias("z"))
    at = [(-20.0, -20.0), (20.0, -20.0), (20.0, 20.0), (-20.0, 20.0)]
    low, top = F.lit(0.0), F.col("top")
    face = lambda kind, pts: F.struct(F.lit(kind).alias("id"), F.lit(kind).alias("kind"), F.array(F.array(*pts, pts[0])).alias("rings"))
    faces = [face("GroundSurface", [corner(*c, low) for c in at]), face("RoofSurface", [corner(*c, top) for c in at])]
    faces += [face("WallSurface", [corner(*a, low), corner(*b, low), corner(*b, top), corner(*a, top)]) for a, b in zip(at, at[1:] + at[:1], strict=True)]
    solid = F.struct(F.lit(2).alias("lod"), F.array(*faces).alias("surfaces"), F.array().cast("array<string>").alias("unresolved"))
    b = st.select(F.col("station_id").cast("string").alias("building_id"), F.lit(None).cast("double").alias("measured_height"), F.array(F.struct(F.lit("p").alias("part_id"), solid.alias("lod1"), solid.alias("lod2"))).alias("parts"))
    az, el = solar.solar_position(F.unix_timestamp("instant").cast("double"), F.lit(35.68), F.lit(139.75))
    # Written tables, as a source would give them: the optimizer would copy these
    # expressions into every use otherwise.
    sun = scratch.write(solar.scenarios(s).select("scenario", az.alias("azimuth"), el.alias("elevation")))
    selected = scratch.write(cover.select_solids(scratch.write(b)))
    return selected, sun


@query()
def building_shade(s, d):
    """Shade on each edge and scenario from a tower at every station; tests hold it against a known shadow."""
    scratch = Scratch(s, "buildings")
    selected, sun = _towers(s, d, scratch)
    return cover.shade_scores(scratch.write(_metric_lines(s, d)), selected, sun).select("edge_id", "scenario", r6(F.col("score"), 4).alias("score"))


@query(_ROUTES + """, l AS (SELECT t.od_id, t.mode, coalesce(string_agg(edge_id, ',' ORDER BY seq), '') AS p FROM total t LEFT JOIN steps USING (od_id, mode) GROUP BY 1, 2),
w AS (SELECT od_id, max(p) FILTER (mode = 'fastest') = max(p) FILTER (mode = 'coolest') AS same FROM l GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY od_id) AS nth FROM w)
SELECT od_id, same, nth FROM k WHERE nth <= CASE WHEN same THEN 2 ELSE 3 END""")
def route_cases(s, d):
    return evaluation.find_cases(paths_of(s, d)).withColumn("nth", F.col("nth").cast("long"))


@query(_ROUTES + """, l AS (SELECT t.od_id, t.mode, coalesce(string_agg(edge_id, ',' ORDER BY seq), '') AS p FROM total t LEFT JOIN steps USING (od_id, mode) GROUP BY 1, 2),
w AS (SELECT od_id, max(p) FILTER (mode = 'fastest') AS f, max(p) FILTER (mode = 'balanced') AS b, max(p) FILTER (mode = 'coolest') AS c FROM l GROUP BY 1)
SELECT count(*) AS total, count(CASE WHEN f = b THEN 1 END) AS fastest_equals_balanced, count(CASE WHEN f = c THEN 1 END) AS fastest_equals_coolest, count(CASE WHEN b = c THEN 1 END) AS balanced_equals_coolest, count(CASE WHEN f = b AND f = c THEN 1 END) AS all_equal,
 count(CASE WHEN NOT (f = b AND f = c) THEN 1 END) AS not_all_equal FROM w""")
def equality_summary(s, d):
    out = evaluation.equality_summary(routes.path_equality(paths_of(s, d)))
    return out.select("total", "fastest_equals_balanced", "fastest_equals_coolest", "balanced_equals_coolest", "all_equal", "not_all_equal")


@query(with_views("road_edges") + f" SELECT edge_id, 'LineString' AS kind, round({_BASE}, 10) AS heat FROM road_edges")
def heat_features(s, d):
    """GeoJSON features of the heat layer, read back from their text."""
    nodes = nodes_of(s, d)
    e = routes.edge_geometry(edges_of(s, d), nodes).withColumn("heat", r6(exposure.base_exposure(), 10))
    text = routes.feature_collection(e, "geometry", ["edge_id", "heat"])
    f = F.from_json("feature", "properties struct<edge_id: string, heat: double>, geometry struct<type: string, coordinates: array<array<double>>>")
    return text.select(f.alias("f")).select("f.properties.edge_id", F.col("f.geometry.type").alias("kind"), "f.properties.heat")


@query("SELECT extract(hour FROM ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(s, d):
    """Event counts by hour of the day; an addition beside the routing model."""
    return load(s, d, "events").groupBy(F.hour("ts").cast("long").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
