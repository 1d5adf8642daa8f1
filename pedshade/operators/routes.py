"""Metrics, comparisons and geometry of routes, and the three-mode bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedshade.config import DEFAULT, MODES, SHADE_COLUMNS, Config
from pedshade.functions import compare
from pedshade.functions.exposure import base_exposure, edge_cost, shade_exposure
from pedshade.operators.routing import Router


def _lit(x: float) -> Column:
    return F.lit(float(x))


def route_finder(edges: DataFrame, scenario: str | None = None, config: Config = DEFAULT, modes: tuple[str, ...] = MODES, nodes: DataFrame | None = None) -> Router:
    """One graph with every mode's costs, for any number of calls; ``nodes`` places a graph too large to broadcast."""
    return Router(edges, {m: edge_cost(m, scenario, config) for m in modes}, nodes=nodes)


def route_bundle(od: DataFrame, edges: DataFrame, scenario: str | None = None, config: Config = DEFAULT, modes: tuple[str, ...] = MODES, nodes: DataFrame | None = None) -> DataFrame:
    """Shortest paths of every mode for every origin and destination."""
    return route_finder(edges, scenario, config, modes, nodes).paths(od)


def path_rows(paths: DataFrame) -> DataFrame:
    """``(od_id, mode, seq, edge_id)``, one row for each edge of a path."""
    return paths.select("od_id", "mode", F.posexplode("edge_ids").alias("seq", "edge_id"))


def route_metrics(paths: DataFrame, edges: DataFrame, scenario: str | None = None, config: Config = DEFAULT, digits: int | None = None) -> DataFrame:
    """Length, time, exposure and indicators of every found route; an empty one has zeros.

    Edges join only once the paths are known, so that their columns are read
    for the chosen edges alone.  ``digits`` rounds the doubles.
    """
    x = base_exposure(config)
    columns = [F.col("edge_id"), F.col("length"), x.alias("x"), F.col("green_score"), F.col("water_penalty")]
    sums = {
        "distance_m": F.col("length"),
        "exposure_load": F.col("length") * F.col("x"),
        "_green": F.col("length") * F.col("green_score"),
        "_water": F.col("length") * F.col("water_penalty"),
    }
    if scenario is not None:
        shade = F.col(SHADE_COLUMNS[scenario])
        columns += [shade.alias("shade"), shade_exposure(shade, config).alias("sx")]
        sums |= {
            "_shade": F.col("length") * F.col("shade"),
            "shade_exposure_load": F.col("length") * F.col("sx"),
            "unshaded_m": F.col("length") * (_lit(1) - F.col("shade")),
        }
    totals = (
        path_rows(paths).join(edges.select(*columns), "edge_id").groupBy("od_id", "mode")
        .agg(F.count(F.lit(1)).alias("edge_count"), *[F.sum(c).alias(n) for n, c in sums.items()])
    )
    found = paths.filter("found").select("od_id", "mode", "total_cost").join(totals, ["od_id", "mode"], "left").na.fill(0)
    mean = lambda part: F.coalesce(F.try_divide(F.col(part), F.nullif("distance_m", _lit(0))), _lit(0))
    out = {
        "edge_count": F.col("edge_count").cast("long"),
        "total_cost": F.col("total_cost"),
        "distance_m": F.col("distance_m"),
        "walking_s": F.col("distance_m") / _lit(config.walking_speed),
        "average_exposure": mean("exposure_load"),
        "exposure_load": F.col("exposure_load"),
        "green_indicator": mean("_green"),
        "water_access": F.when(F.col("distance_m") > 0, _lit(1) - mean("_water")).otherwise(_lit(0)),
    }
    if scenario is not None:
        out |= {
            "average_shade": mean("_shade"),
            "shade_average_exposure": mean("shade_exposure_load"),
            "shade_exposure_load": F.col("shade_exposure_load"),
            "unshaded_m": F.col("unshaded_m"),
            "scenario": F.lit(scenario),
        }
    if digits is not None:
        out = {n: c if n in ("edge_count", "scenario") else F.round(c, digits) + _lit(0) for n, c in out.items()}
    return found.select("od_id", "mode", *[c.alias(n) for n, c in out.items()])


def compare_to_fastest(metrics: DataFrame, shade: bool = False, config: Config = DEFAULT) -> DataFrame:
    """Differences of every other mode from the fastest route of its origin and destination, and the detour guard."""
    names = ["distance_m", "walking_s", "average_exposure", "exposure_load", "green_indicator", "water_access"]
    names += ["shade_average_exposure", "shade_exposure_load"] if shade else []
    fastest = metrics.filter("mode = 'fastest'").select("od_id", *[F.col(n).alias(f"f_{n}") for n in names])
    columns = compare.comparison() | (compare.shade_comparison() if shade else {})
    columns |= {
        "green_indicator_change": F.col("green_indicator") - F.col("f_green_indicator"),
        "water_access_change": F.col("water_access") - F.col("f_water_access"),
        "passes_guard": compare.passes_detour_guard(F.col("distance_m"), F.col("f_distance_m"), config),
    }
    return metrics.filter("mode <> 'fastest'").join(fastest, "od_id").select("od_id", "mode", *[c.alias(n) for n, c in columns.items()])


def path_equality(paths: DataFrame) -> DataFrame:
    """Which modes share their path, by origin and destination."""
    wide = paths.groupBy("od_id").agg(*[F.first(F.when(F.col("mode") == m, F.col("edge_ids")), ignorenulls=True).alias(m) for m in MODES])
    fb, fc, bc = (F.coalesce(F.col(a) == F.col(b), F.lit(False)) for a, b in (("fastest", "balanced"), ("fastest", "coolest"), ("balanced", "coolest")))
    return wide.select("od_id", fb.alias("fastest_equals_balanced"), fc.alias("fastest_equals_coolest"), bc.alias("balanced_equals_coolest"), (fb & fc).alias("all_equal"))


def continuity_violations(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of a path that do not start where the one before them ended."""
    w = Window.partitionBy("od_id", "mode").orderBy("seq")
    rows = path_rows(paths).join(edges.select("edge_id", "source", "target"), "edge_id", "left")
    prior = F.lag("target").over(w)
    return rows.withColumn("prior", prior).filter(F.col("source").isNull() | (F.col("prior") != F.col("source"))).select("od_id", "mode", "seq", "edge_id")


def edge_geometry(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a two-point ``geometry`` from source to target."""
    point = lambda p: F.struct(F.col(f"{p}.lon").alias("lon"), F.col(f"{p}.lat").alias("lat"))
    a, b = nodes.alias("a"), nodes.alias("b")
    return (
        edges.join(a, F.col("source") == F.col("a.node_id")).join(b, F.col("target") == F.col("b.node_id"))
        .select(*[edges[c] for c in edges.columns], F.array(point("a"), point("b")).alias("geometry"))
    )


def route_geometry(paths: DataFrame, edges_with_geometry: DataFrame) -> DataFrame:
    """``(od_id, mode, geometry)``: points in path order, seam points once; null for an empty route."""
    rows = path_rows(paths).join(edges_with_geometry.select("edge_id", "geometry"), "edge_id")
    part = F.when(F.col("seq") == 0, F.col("geometry")).otherwise(F.slice("geometry", 2, F.greatest(F.lit(0), F.size("geometry") - 1)))
    lines = rows.groupBy("od_id", "mode").agg(F.array_sort(F.collect_list(F.struct("seq", part.alias("part")))).alias("parts"))
    lines = lines.select("od_id", "mode", F.flatten(F.transform("parts", lambda p: p["part"])).alias("geometry"))
    return paths.filter("found").select("od_id", "mode").join(lines, ["od_id", "mode"], "left")


def oriented(geometry: Column, source: Column, target: Column) -> Column:
    """Reversed where that is strictly nearer to source and target; a straight line for a missing geometry."""
    d = lambda p, q: F.hypot(p["lon"] - q["lon"], p["lat"] - q["lat"])
    first, last = F.element_at(geometry, 1), F.element_at(geometry, -1)
    forward, backward = d(first, source) + d(last, target), d(last, source) + d(first, target)
    return F.coalesce(F.when(backward < forward, F.reverse(geometry)).otherwise(geometry), F.array(source, target))


def feature_collection(rows: DataFrame, geometry: str, properties: list[str], kind: str = "LineString") -> DataFrame:
    """GeoJSON features as text, one a row; a file of them is the sink's matter."""
    coordinates = F.transform(geometry, lambda p: F.array(p["lon"], p["lat"])) if kind == "LineString" else F.array(F.col(geometry)["lon"], F.col(geometry)["lat"])
    return rows.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(*properties).alias("properties"),
                F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            )
        ).alias("feature")
    )
