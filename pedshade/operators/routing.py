"""Weighted shortest paths over a directed multigraph.

Two strategies give the same answers.  A graph whose edges and bytes stay
under ``MAX_BROADCAST_EDGES`` and ``MAX_BROADCAST_BYTES`` goes to every
executor as compressed adjacency arrays, and origins and destinations are
searched partition by partition; beyond that, an overlay of the graph's blocks
(:mod:`pedshade.operators.overlay`) keeps each search near its trip.  Whole
trees go from tile to tile (:mod:`pedshade.operators.trees`) or, without places,
relax over the edge table in rounds of joins.

One rule decides between paths of equal cost, so that results depend neither
on the strategy nor on the order of a heap.  Every node has a label (cost,
level, edge id, prior node) and takes its least.  The level is 0 where the
last edge raised the cost, else one more than the prior node's: on a plateau
of edges that cost nothing, paths run outwards from where it is entered and
never in a circle.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedshade.operators.overlay import BLOCK_NODES, Overlay
from pedshade.operators.trees import TILE_NODES, tiled_trees
from pedshade.operators.windows import Windows
from pedshade.runtime import Scratch, frame

MAX_BROADCAST_EDGES = 1_000_000
MAX_BROADCAST_BYTES = 128 << 20


class Adjacency:
    """Compressed adjacency of one graph with a cost array for each mode.

    Nodes and edges are numbered in ascending order of their ids; out-edges of
    a node stand in edge-id order.
    """

    def __init__(self, edges: pd.DataFrame, modes: list[str]):
        edges = edges.sort_values(["edge_id", "source", "target"], kind="stable").reset_index(drop=True)
        src, dst = edges.source.to_numpy(), edges.target.to_numpy()
        self.nodes = np.unique(np.concatenate([src, dst])) if len(edges) else np.zeros(0, np.int64)
        s, t = np.searchsorted(self.nodes, src), np.searchsorted(self.nodes, dst)
        order = np.argsort(s, kind="stable")
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(self.nodes)))]).astype(np.int64)
        self.targets = t[order].astype(np.int64)
        self.sources = s[order].astype(np.int64)
        self.rank = order.astype(np.int64)  # edge number of each slot, its id's rank
        self.ids = edges.edge_id.to_numpy().astype(str) if len(edges) else np.zeros(0, str)
        self.costs = {m: edges[m].to_numpy(np.float64)[order] for m in modes}
        for m, c in self.costs.items():
            if len(c) and not (np.isfinite(c).all() and (c >= 0).all()):
                raise ValueError(f"costs of {m} must be finite and not negative")
        self._lists: dict[str, tuple] = {}

    def lists(self, mode: str) -> tuple:
        """Plain lists, which the search reads faster than arrays."""
        if "graph" not in self._lists:
            self._lists["graph"] = (self.offsets.tolist(), self.targets.tolist(), self.rank.tolist())
        if mode not in self._lists:
            self._lists[mode] = (*self._lists["graph"], self.costs[mode].tolist())
        return self._lists[mode]

    def search(self, source: int, targets: set[int], mode: str) -> tuple[dict[int, float], dict[int, int]]:
        """Costs of settled nodes, and the slot by which each was reached, until all targets are settled."""
        offsets, heads, rank, cost = self.lists(mode)
        # Labels are (cost, level, edge rank); an edge raises the cost or the level, so nodes settle in their order.
        best, via, settled = {source: (0.0, 0, -1)}, {source: -1}, set()
        left = set(targets)
        heap = [(0.0, 0, source)]
        while heap and left:
            d, level, u = heappop(heap)
            if u in settled:
                continue
            settled.add(u)
            left.discard(u)
            for e in range(offsets[u], offsets[u + 1]):
                v = heads[e]
                if v in settled:
                    continue
                c = d + cost[e]
                label = (c, level + 1 if c == d else 0, rank[e])
                old = best.get(v)
                if old is None or label < old:
                    best[v], via[v] = label, e
                    if old is None or label[:2] < old[:2]:
                        heappush(heap, (c, label[1], v))
        return {t: best[t][0] for t in targets if t in settled}, via

    def path(self, target: int, via: dict[int, int]) -> list[int]:
        slots = []
        while (e := via[target]) >= 0:
            slots.append(e)
            target = int(self.sources[e])
        return slots[::-1]


_PATHS = "od_id long, mode string, found boolean, total_cost double, edge_ids array<string>, nodes array<long>"


def _search_all(shared, modes: list[str]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g: Adjacency = shared.value
        for pdf in parts:
            rows = []
            ends = np.unique(pdf[["source", "target"]].to_numpy())
            at = np.minimum(np.searchsorted(g.nodes, ends), max(0, len(g.nodes) - 1))
            known = {int(n): int(i) for n, i in zip(ends, at, strict=True) if len(g.nodes) and g.nodes[i] == n}
            # One search serves all destinations of a source.
            for source, group in pdf.groupby("source", sort=False):
                goals = {int(t) for t in group.target}
                for mode in modes:
                    s = known.get(int(source))
                    found, via = g.search(s, {known[t] for t in goals if t in known}, mode) if s is not None else ({}, {})
                    for od, target in zip(group.od_id.tolist(), group.target.tolist(), strict=True):
                        t = known.get(int(target))
                        if t is None or t not in found:
                            same = int(target) == int(source)
                            rows.append((od, mode, same, 0.0 if same else None, [], [int(source)] if same else []))
                            continue
                        slots = g.path(t, via)
                        nodes = [int(source), *g.nodes[g.targets[slots]].tolist()] if slots else [int(source)]
                        rows.append((od, mode, True, found[t], g.ids[g.rank[slots]].tolist() if slots else [], nodes))
            yield frame(rows, [c.split()[0] for c in _PATHS.split(", ")])

    return run


def _valid(cost: Column) -> Column:
    return F.coalesce((cost >= 0) & (cost < F.lit(float("inf"))), F.lit(False))


class Router:
    """Searches over one graph for many calls: costs are checked and a strategy is chosen once.

    ``edges`` has edge_id, source and target and what the ``costs`` expressions
    read.  A cost that is null, NaN, infinite or negative is an error, whatever
    the strategy.  ``nodes`` (node_id, lon, lat) lets a graph beyond the limits
    be cut into compact blocks of ``block_nodes`` nodes; without it blocks are
    stretches of node ids.
    """

    def __init__(
        self, edges: DataFrame, costs: dict[str, Column], max_edges: int = MAX_BROADCAST_EDGES, max_bytes: int = MAX_BROADCAST_BYTES,
        nodes: DataFrame | None = None, block_nodes: int = BLOCK_NODES,
    ):
        self.modes = modes = list(costs)
        self.shared = self.graph = None
        priced = edges.select("edge_id", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), *[c.cast("double").alias(m) for m, c in costs.items()])
        # Edges and bytes are measured, and costs checked, before either strategy starts.
        seen = priced.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("edge_id") + 24 + 8 * len(modes)), F.lit(0)).alias("size"),
            *[F.count_if(~_valid(F.col(m))).alias(f"_bad_{m}") for m in modes],
        ).first()
        for m in modes:
            if seen[f"_bad_{m}"]:
                raise ValueError(f"costs of {m} must be finite and not negative")
        if seen["n"] > max_edges or seen["size"] > max_bytes:
            # Both read the costs several times.
            priced = Scratch(edges.sparkSession, "priced").write(priced)
            self.graph = Windows(priced, modes, nodes, block_nodes) if nodes is not None else Overlay(priced, modes, None, block_nodes)
        else:
            self.shared = edges.sparkSession.sparkContext.broadcast(Adjacency(priced.toPandas(), modes))

    def paths(self, od: DataFrame) -> DataFrame:
        """``(od_id, mode, found, total_cost, edge_ids, nodes)`` for each row of ``od`` (od_id, source, target) and mode.

        A row whose source is its target has an empty path of cost 0;
        unreachable rows, and those with a null end, have found false and a null cost.
        """
        every = od.select(*[F.col(c).cast("long").alias(c) for c in ("od_id", "source", "target")])
        ods = every.filter("source is not null and target is not null")
        none = F.array().cast
        nowhere = every.filter("source is null or target is null").select(
            "od_id", F.explode(F.array(*map(F.lit, self.modes))).alias("mode"), F.lit(False).alias("found"), F.lit(None).cast("double").alias("total_cost"),
            none("array<string>").alias("edge_ids"), none("array<bigint>").alias("nodes"),
        )
        if self.graph is not None:
            return self.graph.paths(ods).unionByName(nowhere)
        # Rows of one source meet in one task; sources spread over all cores.
        n = max(od.sparkSession.sparkContext.defaultParallelism, 1)
        return ods.repartition(n, "source").mapInPandas(_search_all(self.shared, self.modes), _PATHS).unionByName(nowhere)


def shortest_paths(
    od: DataFrame, edges: DataFrame, costs: dict[str, Column], max_edges: int = MAX_BROADCAST_EDGES, max_bytes: int = MAX_BROADCAST_BYTES,
    nodes: DataFrame | None = None, block_nodes: int = BLOCK_NODES,
) -> DataFrame:
    """The paths of a :class:`Router` that is asked once."""
    return Router(edges, costs, max_edges, max_bytes, nodes, block_nodes).paths(od)


_TREE = "source long, node long, cost double, level long, edge_id string, prior long"
#: A source's own label; the empty edge id comes before all others.
_START = (0.0, 0, "", -(2**63))


def _settle_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Relaxes one block of nodes to rest: ``left`` has its known labels, ``right`` the edges that leave its nodes.

    Returns improved rows of the block's own nodes (outside 0) and candidates
    for nodes of other blocks (outside 1).
    """
    columns = [*(c.split()[0] for c in _TREE.split(", ")), "outside"]
    if not len(left) or not len(right):
        return frame([], columns)
    block = left["_b"].iloc[0]
    out_of: dict[int, list] = {}
    for row in zip(right["_s"].tolist(), right["_t"].tolist(), right["_c"].tolist(), right["edge_id"].tolist(), right["_tb"].tolist(), strict=True):
        out_of.setdefault(row[0], []).append(row[1:])
    rows = []
    for source, known in left.groupby("source", sort=False):
        best = {r[0]: r[1:] for r in zip(*(known[c].tolist() for c in ("node", "cost", "level", "edge_id", "prior")), strict=True)}
        fresh = known[known["new"]]
        heap = sorted(zip(fresh["cost"].tolist(), fresh["level"].tolist(), fresh["node"].tolist(), strict=True))
        changed: dict[tuple[int, int], None] = {}
        while heap:
            d, level, u = heappop(heap)
            if (d, level) > best[u][:2]:
                continue
            for v, c, e, vb in out_of.get(u, ()):
                cost = d + c
                label = (cost, level + 1 if cost == d else 0, e, u)
                old = best.get(v)
                if old is None or label < old:
                    best[v] = label
                    changed[v, int(vb != block)] = None
                    if vb == block and (old is None or label[:2] < old[:2]):
                        heappush(heap, (cost, label[1], v))
        rows += [(source, v, *best[v], outside) for v, outside in changed]
    return frame(rows, columns)


def relaxed_tree(edges: DataFrame, sources: DataFrame, cost: str = "cost", block_nodes: int = 4096, max_rounds: int = 10_000) -> DataFrame:
    """``(source, node, cost, level, edge_id, prior)`` of all nodes reachable from each of ``sources``, by rounds of joins.

    ``edge_id`` is the last edge of the path and ``prior`` the node it leaves,
    both null at the source itself.  Nodes form blocks of neighbouring ids.  A
    round brings each block that other blocks improved to rest at once, so
    rounds follow the blocks that a path crosses and not its edges, and reads
    only those blocks' edges.  A cost that is null, NaN, infinite or negative
    is an error, as are more than ``max_rounds`` rounds.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "relax")
    block = lambda c: F.floor(F.col(c) / F.lit(block_nodes)).cast("long")
    c = F.col(cost).cast("double")
    checked = F.when(_valid(c), c).otherwise(F.raise_error(F.lit(f"costs of {cost} must be finite and not negative")).cast("double"))
    e = scratch.write(
        edges.select(F.col("source").cast("long").alias("_s"), F.col("target").cast("long").alias("_t"), "edge_id", checked.alias("_c"))
        .withColumns({"_b": block("_s"), "_tb": block("_t")}).repartition("_b")
    )
    start = sources.select(F.col("source").cast("long").alias("source")).filter("source is not null").distinct()
    zero = [F.lit(v).cast(t).alias(n) for v, t, n in zip(_START, ("double", "long", "string", "long"), ("cost", "level", "edge_id", "prior"), strict=True)]
    best = scratch.write(start.select("source", F.col("source").alias("node"), *zero, F.lit(True).alias("new")))
    label = ["cost", "level", "edge_id", "prior"]
    for _ in range(max_rounds):
        placed = best.withColumn("_b", block("node"))
        awake = scratch.write(placed.filter("new").select("_b").distinct())
        if awake.isEmpty():
            at = F.col("edge_id") == ""
            return best.select("source", "node", "cost", "level", F.when(~at, F.col("edge_id")).alias("edge_id"), F.when(~at, F.col("prior")).alias("prior"))
        step = (
            placed.join(awake, "_b", "left_semi").groupBy("_b")
            .cogroup(e.join(awake, "_b", "left_semi").groupBy("_b"))
            .applyInPandas(_settle_block, _TREE + ", outside int")
        )
        both = best.select("source", "node", *label, F.lit(-1).alias("outside")).unionByName(step)
        # A node wakes its block where another block's label is below its own and what its block settled on.
        at = lambda k: F.min(F.when(F.col("outside") == k, F.struct("cost", "level")))
        lower = lambda c: F.col(c).isNull() | (F.struct("b.cost", "b.level") < F.col(c))
        merged = scratch.write(
            both.groupBy("source", "node").agg(F.min(F.struct(*label)).alias("b"), at(-1).alias("old"), at(0).alias("own"))
            .select("source", "node", *[f"b.{c}" for c in label], (lower("old") & lower("own")).alias("new"))
        )
        scratch.drop(best)
        scratch.drop(awake)
        best = merged
    raise RuntimeError(f"distances did not settle within {max_rounds} rounds")


_TREE_COSTS = "source long, node long, cost double"


def _search_trees(shared):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g: Adjacency = shared.value
        every = set(range(len(g.nodes)))
        for pdf in parts:
            for source in pdf.source.tolist():
                at = int(np.searchsorted(g.nodes, source))
                if at == len(g.nodes) or g.nodes[at] != source:
                    yield pd.DataFrame({"source": [source], "node": [source], "cost": [0.0]})
                    continue
                found, _ = g.search(at, every, "cost")
                yield pd.DataFrame({"source": source, "node": g.nodes[list(found)], "cost": list(found.values())})

    return run


def tree_costs(
    edges: DataFrame, sources: DataFrame, cost: str = "cost", max_edges: int = MAX_BROADCAST_EDGES, max_bytes: int = MAX_BROADCAST_BYTES,
    nodes: DataFrame | None = None, block_nodes: int = TILE_NODES,
) -> DataFrame:
    """``(source, node, cost)`` of all nodes reachable from each of ``sources``.

    A graph under the limits is broadcast and each tree searched by one task, a
    tree at a time.  Beyond them :func:`tiled_trees` takes all trees through
    tiles around ``nodes``; without these :func:`relaxed_tree` relaxes by rounds.
    """
    priced = edges.select("edge_id", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), F.col(cost).cast("double").alias("cost"))
    priced = Scratch(edges.sparkSession, "priced").write(priced)
    seen = priced.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("edge_id") + 32), F.lit(0)).alias("size"), F.count_if(~_valid(F.col("cost"))).alias("bad")).first()
    if seen["bad"]:
        raise ValueError(f"costs of {cost} must be finite and not negative")
    if seen["n"] > max_edges or seen["size"] > max_bytes:
        return relaxed_tree(priced, sources).select("source", "node", "cost") if nodes is None else tiled_trees(priced, sources, nodes, block_nodes)
    sc = edges.sparkSession.sparkContext
    shared = sc.broadcast(Adjacency(priced.toPandas(), ["cost"]))
    starts = sources.select(F.col("source").cast("long").alias("source")).filter("source is not null").distinct()
    return starts.repartition(max(2 * sc.defaultParallelism, 1), "source").mapInPandas(_search_trees(shared), _TREE_COSTS)


_WALK = "od_id long, source long, target long, total_cost double, at long, edge_ids array<string>, nodes array<long>"


def _walk_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Walks paths back over one source's tree until they leave the block or reach the source."""
    via = {n: (e, p) for n, e, p in zip(right["node"].tolist(), right["edge_id"].tolist(), right["prior"].tolist(), strict=True)}
    rows = []
    for od, source, target, cost, at, edges, nodes in zip(*(left[c.split()[0]].tolist() for c in _WALK.split(", ")), strict=True):
        back_edges, back_nodes = [], []
        while at != source and at in via:
            edge, at = via[at]
            back_edges.append(edge)
            back_nodes.append(int(at))
        rows.append((od, source, target, cost, int(at), back_edges[::-1] + list(edges), back_nodes[::-1] + list(nodes)))
    return frame(rows, [c.split()[0] for c in _WALK.split(", ")])


def relaxed_paths(od: DataFrame, priced: DataFrame, mode: str, block_nodes: int = 4096, max_rounds: int = 10_000) -> DataFrame:
    """The result of :func:`shortest_paths` for one mode without a broadcast graph.

    Paths are walked back a block of the tree at a time; a round moves every
    open path out of the block it is in.  More than ``max_rounds`` rounds are
    an error: no path is ever cut.
    """
    scratch = Scratch(od.sparkSession, "paths")
    tree = scratch.write(relaxed_tree(priced, od, mode, block_nodes, max_rounds))
    goals = od.join(tree.select("source", F.col("node").alias("target"), F.col("cost").alias("total_cost")), ["source", "target"], "left")
    walk = scratch.write(goals.select("od_id", "source", "target", "total_cost", F.col("target").alias("at"), F.array().cast("array<string>").alias("edge_ids"), F.array("target").alias("nodes")))
    block = F.floor(F.col("at") / F.lit(block_nodes)).cast("long")
    back = tree.select(F.col("source").alias("_src"), "node", "edge_id", "prior", F.floor(F.col("node") / F.lit(block_nodes)).cast("long").alias("_b"))
    open_ = F.col("total_cost").isNotNull() & (F.col("at") != F.col("source"))
    steps = [walk]
    for _ in range(max_rounds):
        going = walk.filter(open_).withColumns({"_src": F.col("source"), "_b": block})
        if going.isEmpty():
            break
        blocks = going.select("_src", "_b").distinct()
        step = (
            going.groupBy("_src", "_b")
            .cogroup(back.join(blocks, ["_src", "_b"], "left_semi").groupBy("_src", "_b"))
            .applyInPandas(_walk_block, _WALK)
        )
        walk = scratch.write(step)
        steps.append(walk)
    else:
        raise RuntimeError(f"paths were not walked back within {max_rounds} rounds")
    # Each path is closed in just one of the steps' tables.
    done = od.sparkSession.read.schema(walk.schema).parquet(*[t._scratch_path for t in steps]).filter(~open_)
    same = F.col("source") == F.col("target")
    found = F.col("total_cost").isNotNull() | same
    return done.select(
        "od_id", F.lit(mode).alias("mode"), found.alias("found"), F.when(same, F.lit(0.0)).otherwise(F.col("total_cost")).alias("total_cost"),
        "edge_ids", F.when(found, F.col("nodes")).otherwise(F.array().cast("array<bigint>")).alias("nodes"),
    )
