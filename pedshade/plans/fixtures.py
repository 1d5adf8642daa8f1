"""Road network, stations, points and events derived from the driver's tables.

Each view is one SQL text that Spark and DuckDB both run, with ``{name}`` for
the tables and views it reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "road_nodes": """
WITH g AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM {part})
SELECT p.p_partkey AS node_id,
       CAST(139.60 AS DOUBLE) + CAST(p.p_partkey % g.w AS DOUBLE) * CAST(0.001 AS DOUBLE) AS lon,
       CAST(35.55 AS DOUBLE) + floor(CAST(p.p_partkey AS DOUBLE) / g.w) * CAST(0.001 AS DOUBLE) AS lat
FROM {part} p CROSS JOIN g""",
    "road_edges": """
WITH g AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM {part}),
attr AS (SELECT l_partkey AS pk,
                least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), round(avg(l_discount) * 10, 6))) AS green,
                round(avg(l_quantity), 6) AS qty
         FROM {lineitem} GROUP BY l_partkey),
pairs AS (
  SELECT a.p_partkey AS s, b.p_partkey AS t, 0 AS k FROM {part} a CROSS JOIN g JOIN {part} b
    ON b.p_partkey = a.p_partkey + 1 AND b.p_partkey % g.w <> 0
  UNION ALL SELECT a.p_partkey, b.p_partkey, 0 FROM {part} a CROSS JOIN g JOIN {part} b ON b.p_partkey = a.p_partkey + g.w
  UNION ALL SELECT a.p_partkey, b.p_partkey, 1 FROM {part} a CROSS JOIN g JOIN {part} b ON b.p_partkey = a.p_partkey + g.w
    WHERE a.p_partkey % 7 = 0),
dirs AS (SELECT s, t, k FROM pairs UNION ALL SELECT t, s, k FROM pairs),
d AS (SELECT s, t, k, CAST((least(s, t) * 37) % 700 AS DOUBLE) AS station_m FROM dirs)
SELECT concat(CAST(s AS VARCHAR(20)), ':', CAST(t AS VARCHAR(20)), ':', CAST(k AS VARCHAR(20))) AS edge_id,
       s AS source, t AS target,
       round(60 + coalesce(attr.qty, CAST(25 AS DOUBLE)) + 13 * k, 6) AS length,
       coalesce(attr.green, CAST(0 AS DOUBLE)) AS green_score,
       CAST(CASE WHEN station_m <= 100 THEN 0 WHEN station_m <= 300 THEN 0.3 WHEN station_m <= 500 THEN 0.6 ELSE 1 END AS DOUBLE) AS water_penalty,
       CAST((s * 31 + t * 17) % 101 AS DOUBLE) / 100 AS shade_0900,
       CAST((s * 13 + t * 7 + 5) % 101 AS DOUBLE) / 100 AS shade_1200,
       CAST((s * 11 + t * 29 + 9) % 101 AS DOUBLE) / 100 AS shade_1500
FROM d LEFT JOIN attr ON attr.pk = least(s, t)""",
    "stations": """
WITH g AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM {part})
SELECT s_suppkey AS station_id,
       CAST(139.60 AS DOUBLE) + CAST((s_suppkey * 7919) % (g.w * 10) AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS lon,
       CAST(35.55 AS DOUBLE) + CAST((s_suppkey * 104729) % (g.w * 10) AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS lat,
       s_name AS name, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE concat('floor-', CAST(s_nationkey AS VARCHAR(10))) END AS location
FROM {supplier} CROSS JOIN g""",
    "snap_points": """
WITH g AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM {part})
SELECT c_custkey AS point_id,
       CAST(139.59 AS DOUBLE) + CAST((c_custkey * 7907) % (g.w * 10 + 200) AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS lon,
       CAST(35.54 AS DOUBLE) + CAST((c_custkey * 104723) % (g.w * 10 + 200) AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS lat
FROM {customer} CROSS JOIN g""",
    # One trip for each row of the street grid, from a node of that row; trips grow with the grid's side.
    "od_pairs": """
WITH g AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w, count(*) AS n FROM {part}),
rows_of AS (SELECT CAST(floor(CAST(p_partkey AS DOUBLE) / g.w) AS BIGINT) AS k, min(p_partkey) AS first FROM {part} CROSS JOIN g GROUP BY 1)
SELECT k AS od_id, (first + (k * 13) % g.w) % g.n AS source,
       ((first + (k * 13) % g.w) % g.n + (k % 9) * g.w + (k * 5) % 11) % g.n AS target
FROM rows_of CROSS JOIN g""",
    # One trip for each station.
    "station_trips": """
WITH g AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w, count(*) AS n FROM {part})
SELECT CAST(s_suppkey AS BIGINT) AS od_id, (s_suppkey * 7919) % g.n AS source,
       ((s_suppkey * 7919) % g.n + (s_suppkey % 23) * g.w + (s_suppkey * 5) % 31) % g.n AS target
FROM {supplier} CROSS JOIN g""",
    "edge_intervals": """
SELECT l_partkey AS edge_key, CASE l_returnflag WHEN 'A' THEN '09:00' WHEN 'N' THEN '12:00' ELSE '15:00' END AS scenario,
       CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 0 THEN 'footprint' ELSE 'shadow' END AS kind,
       CAST(l_quantity AS DOUBLE) AS s, CAST(l_quantity AS DOUBLE) + CAST(l_suppkey % 7 AS DOUBLE) AS e FROM {lineitem}""",
    "ui_events": """
SELECT user_id AS session_id, event_id, ts,
       CASE event_type WHEN 'click' THEN 'MAP_CLICK' WHEN 'view' THEN 'ROUTE_MODE_SELECTED' WHEN 'signup' THEN 'SELECT_START_REQUESTED'
            WHEN 'purchase' THEN 'SELECT_DESTINATION_REQUESTED' ELSE 'CANDIDATE_REJECTED' END AS action,
       CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'fastest' WHEN 1 THEN 'balanced' ELSE 'coolest' END AS mode FROM {events}""",
}


#: The one row that every view calls g: the grid's width and its number of nodes.
_GRID = "SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w, count(*) AS n FROM {part}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over the tables, as a DataFrame.

    The grid comes as a hinted relation of its own: the optimizer leaves joins
    with a hint where they stand.  It would otherwise join the two sides of
    ``b = a + g.w`` before ``g``, on an inferred condition that is no equality,
    which pairs all nodes with all others.
    """
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("CROSS JOIN g", "CROSS JOIN {grid} g")
    inputs = {n: load(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text)) - {"grid"}}
    if text != VIEWS[name]:
        inputs["grid"] = F.broadcast(spark.sql(_GRID, part=inputs["part"] if "part" in inputs else load(spark, sf_dir, "part")))
    return spark.sql(text, **inputs)


def with_views(*names: str) -> str:
    """``WITH name AS (...), ...`` for DuckDB, to go before a query or further CTEs."""
    tables = {t: t for t in [*TABLES, *VIEWS]}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].format(**tables)})" for n in names)
