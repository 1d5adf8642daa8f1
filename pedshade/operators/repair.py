"""Connectivity repair: bridges between large components along a spanning tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedshade.config import MAJOR_COMPONENT_NODES, RETAINED_COMPONENT_NODES, SEARCH_GRID_DEGREES
from pedshade.operators.components import component_sizes, connected_components
from pedshade.operators.spatial import nearest_component_pairs
from pedshade.runtime import Scratch

ENVIRONMENT = ("green_score", "water_penalty", "shade_0900", "shade_1200", "shade_1500")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node, edges taken as undirected; a lone node is its own component."""
    linked = connected_components(edges, "source", "target")
    return nodes.select(F.col("node_id").cast("long").alias("node")).join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def keep_components(components: DataFrame, least: int = RETAINED_COMPONENT_NODES) -> DataFrame:
    big = component_sizes(components).filter(F.col("n_nodes") >= least).select("component")
    return components.join(big, "component", "left_semi")


def spanning_bridges(pairs: DataFrame, require: int | None = None) -> DataFrame:
    """The pairs of a minimum spanning forest over components, by rounds of cheapest links.

    Every tree takes its cheapest outgoing pair each round (ties by component
    ids), and trees that meet become one, so rounds grow with the logarithm of
    the component count.  ``require`` is the number of components that must end
    up connected; fewer bridges than that minus one are an error.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "bridges")
    order = F.struct("length", "comp_a", "comp_b")
    left = scratch.write(pairs.select("*", F.col("comp_a").alias("ta"), F.col("comp_b").alias("tb")))
    chosen = None
    while not left.isEmpty():
        ends = left.select(F.col("ta").alias("t"), order.alias("o")).unionByName(left.select(F.col("tb").alias("t"), order.alias("o")))
        best = scratch.write(ends.groupBy("t").agg(F.min("o").alias("o")).select(F.col("o.comp_a").alias("comp_a"), F.col("o.comp_b").alias("comp_b")).distinct())
        picked = scratch.write(left.join(best, ["comp_a", "comp_b"]))
        chosen = picked.drop("ta", "tb") if chosen is None else chosen.unionByName(picked.drop("ta", "tb"))
        trees = connected_components(picked, "ta", "tb")
        for end in ("ta", "tb"):
            left = left.join(trees.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        left = scratch.write(left.filter("ta <> tb"))
    out = chosen if chosen is not None else pairs.limit(0)
    if require is not None and out.count() != max(0, require - 1):
        raise ValueError(f"the components cannot all be connected: {require - 1} bridges are needed")
    return out


def bridge_environment(bridges: DataFrame, edges: DataFrame) -> DataFrame:
    """Bridges with the mean of their two ends' mean incident scores, held in [0, 1]; a loop counts once at its node."""
    wanted = bridges.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
    touching = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node"), *ENVIRONMENT)
    means = touching.join(wanted, "node", "left_semi").groupBy("node").agg(*[F.avg(c).alias(c) for c in ENVIRONMENT])
    a, b = means.alias("a"), means.alias("b")
    both = bridges.join(a, F.col("node_a") == F.col("a.node")).join(b, F.col("node_b") == F.col("b.node"))
    mean = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(f"a.{c}") + F.col(f"b.{c}")) / F.lit(2.0)))
    return both.select(*[bridges[c] for c in bridges.columns], *[mean(c).alias(c) for c in ENVIRONMENT])


def bridge_edges(bridges: DataFrame) -> DataFrame:
    """Two directed edges for each bridge."""
    end = lambda s, t: bridges.select(F.concat_ws(":", s, t, F.lit("bridge")).alias("edge_id"), F.col(s).alias("source"), F.col(t).alias("target"), "length", *ENVIRONMENT)
    return end("node_a", "node_b").unionByName(end("node_b", "node_a"))


def repair(nodes: DataFrame, edges: DataFrame, major: int = MAJOR_COMPONENT_NODES, grid: float = SEARCH_GRID_DEGREES) -> DataFrame:
    """``edges`` and the bridges that join all components of ``major`` nodes and more.

    A graph that is joined already comes back unchanged.
    """
    scratch = Scratch(nodes.sparkSession, "repair")
    comps = scratch.write(keep_components(weak_components(nodes, edges), major))
    n = comps.select("component").distinct().count()
    columns = ["edge_id", "source", "target", "length", *ENVIRONMENT]
    if n < 2:
        return edges.select(*columns)
    bridges = spanning_bridges(scratch.write(nearest_component_pairs(nodes, comps, grid)), n)
    return edges.select(*columns).unionByName(bridge_edges(bridge_environment(bridges, edges)))


def union_graphs(graphs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keyed union: rows of one key collapse to the first table's."""
    tagged = None
    for i, g in enumerate(graphs):
        part = g.withColumn("_i", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    rest = [c for c in graphs[0].columns if c not in keys]
    best = tagged.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_i").alias("r")) if rest else tagged.select(*keys).distinct()
    return best.select(*keys, *[F.col(f"r.{c}") for c in rest])
