"""Goal-directed shortest paths over graphs that no executor holds whole.

Nodes are put in an order that keeps neighbours together and cut into blocks,
and a number of blocks in a row is a cell, what one task reads at a time.  The
overlay has the blocks' entries, nodes that an edge from another block leads
to, as nodes, and as arcs the shortest ways between them that meet no third
entry.  It is computed once for any number of trips.

A trip spreads over the overlay from its source, never further than the best
way to its target that is known so far, and back from the target over the
entries that can lie on a way of that cost.  The blocks of those entries are
its corridor, and only there the exact labels of
:mod:`pedshade.operators.routing` are worked out, entry by entry of the cells,
and walked back.  No table has a row for each trip and node of the graph.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedshade.operators.ranks import gapless_rank
from pedshade.runtime import Scratch, frame, unbroadcast

BLOCK_NODES, CELL_BLOCKS = 1024, 16
#: Trips that one task takes through a cell at once.
BATCH_TRIPS = 256
MAX_ROUNDS = 10_000

#: Sums along the overlay group their terms differently from sums along a path; bounds leave that much room.
ROOM = 1e-9

_ARC = "m int, v long, vb long, w long, wb long, c double"
_REACH = "trip long, m int, node long, b long, cost double, outside int"
#: A trip's own label at its source; the empty edge id comes before all others.
_START = (0.0, 0, "", -(2**63))


def z_order(x: Column, y: Column, bits: int = 16) -> Column:
    """Bits of two numbers in [0, 1), interleaved: near points have near codes."""
    code = F.lit(0).cast("long")
    for axis, shift in ((x, 0), (y, 1)):
        v = F.floor(axis * (1 << bits)).cast("long")
        for k in range(bits):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1)), 2 * k + shift))
    return code


def _frames(pdf: pd.DataFrame, *names: str) -> Iterable[tuple]:
    return zip(*(pdf[n].tolist() for n in names), strict=True)


def _distances(start: dict[int, float], out_of: dict[int, list[tuple]], stop: Iterable[int] = (), most: float = float("inf")) -> dict[int, float]:
    """Costs by Dijkstra's rule; nodes in ``stop`` are reached but not left, and nothing above ``most`` is."""
    best, done, ends = dict(start), set(), set(stop)
    heap = [(c, n) for n, c in start.items()]
    heap.sort()
    while heap:
        d, u = heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u in ends:
            continue
        for v, c in out_of.get(u, ()):
            new = d + c
            if new <= most and new < best.get(v, float("inf")):
                best[v] = new
                heappush(heap, (new, v))
    return best


def _arcs_of_block(edges: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Arcs that start at a block's entries."""
    rows: list[tuple] = []
    if len(edges) and len(entries):
        m, block = int(edges["m"].iloc[0]), int(edges["sb"].iloc[0])
        out_of: dict[int, list] = {}
        block_of: dict[int, int] = {}
        for s, t, tb, c in _frames(edges, "s", "t", "tb", "c"):
            out_of.setdefault(s, []).append((t, c))
            block_of[t] = tb
        own = set(entries["t"].tolist())
        away = {t for t, b in block_of.items() if b != block}
        for v in sorted(own):
            reached = _distances({v: 0.0}, out_of, (own | away) - {v})
            rows += [(m, v, block, w, block_of[w], c) for w, c in reached.items() if w != v and (w in own or w in away)]
    return frame(rows, [f.split()[0] for f in _ARC.split(", ")])


def _leave_block(trips: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The entries of other blocks that trips reach from their source's block, and, as outside 0, the target inside it."""
    rows: list[tuple] = []
    if len(trips) and len(edges):
        block = int(edges["sb"].iloc[0])
        out_of: dict[int, list] = {}
        block_of: dict[int, int] = {}
        for s, t, tb, c in _frames(edges, "s", "t", "tb", "c"):
            out_of.setdefault(s, []).append((t, c))
            block_of[t] = tb
        away = {t for t, b in block_of.items() if b != block}
        for trip, m, source, target in _frames(trips, "trip", "m", "source", "target"):
            reached = _distances({source: 0.0}, out_of, away)
            rows += [(trip, m, w, block_of[w], reached[w], 1) for w in away & reached.keys()]
            if target in reached and target not in away:
                rows.append((trip, m, target, block, reached[target], 0))
    return frame(rows, [f.split()[0] for f in _REACH.split(", ")])


def _reach_target(trips: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The entries of the target's block from which it is reached inside the block."""
    rows: list[tuple] = []
    if len(trips) and len(edges):
        block = int(edges["tb"].iloc[0])
        into: dict[int, list] = {}
        own = set()
        for s, t, sb, c in _frames(edges, "s", "t", "sb", "c"):
            if sb == block:
                into.setdefault(t, []).append((s, c))
            else:
                own.add(t)
        for trip, m, target in _frames(trips, "trip", "m", "target"):
            reached = _distances({target: 0.0}, into)
            rows += [(trip, m, w, block, reached[w], 1) for w in own & reached.keys()]
    return frame(rows, [f.split()[0] for f in _REACH.split(", ")])


def _spread_cell(cell_blocks: int):
    """Relaxes trips' costs over a cell's arcs: improved entries of the cell are outside 0, those of other cells 1."""

    def run(held: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(held) and len(arcs):
            out_of: dict[int, list] = {}
            block_of: dict[int, int] = {}
            for v, w, wb, c in _frames(arcs, "v", "w", "wb", "c"):
                out_of.setdefault(v, []).append((w, c))
                block_of[w] = wb
            cell = int(held["cell"].iloc[0])
            for trip, known in held.groupby("trip", sort=False):
                old = dict(_frames(known, "node", "cost"))
                new = dict(_frames(known[known["new"]], "node", "cost"))
                heap = sorted((c, n) for n, c in new.items())
                best, most, moved = dict(old), float(known["most"].iloc[0]), set()
                while heap:
                    d, u = heappop(heap)
                    if d > best[u]:
                        continue
                    for w, c in out_of.get(u, ()):
                        cost = d + c
                        if cost <= most and cost < best.get(w, float("inf")):
                            best[w] = cost
                            moved.add(w)
                            if block_of[w] // cell_blocks == cell:
                                heappush(heap, (cost, w))
                m = int(known["m"].iloc[0])
                rows += [(trip, m, w, block_of[w], best[w], int(block_of[w] // cell_blocks != cell)) for w in moved]
        return frame(rows, [f.split()[0] for f in _REACH.split(", ")])

    return run


_LABEL = "trip long, m int, node long, b long, cost double, level long, edge_id string, prior long"


def _labels_in_cell(known: pd.DataFrame, out_of: dict[int, list[tuple]], cell: int, cell_blocks: int) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """Exact labels of one trip inside a cell's corridor, and the labels that its edges give to nodes of other cells."""
    most, blocks = float(known["most"].iloc[0]), set(known["blocks"].iloc[0])
    best = {n: label for n, *label in _frames(known, "node", "cost", "level", "edge_id", "prior")}
    best = {n: tuple(label) for n, label in best.items()}
    heap = sorted((label[0], label[1], n) for n, label in best.items())
    away: dict[int, tuple] = {}
    while heap:
        d, level, u = heappop(heap)
        if (d, level) > best[u][:2]:
            continue
        for v, vb, c, e in out_of.get(u, ()):
            cost = d + c
            if cost > most:
                continue
            label = (cost, level + 1 if cost == d else 0, e, u)
            if vb // cell_blocks != cell:
                if v not in away or label < away[v][:4]:
                    away[v] = (*label, vb)
            elif vb in blocks:
                old = best.get(v)
                if old is None or label < old:
                    best[v] = label
                    if old is None or label[:2] < old[:2]:
                        heappush(heap, (cost, label[1], v))
    return best, away


def _edges_by_node(edges: pd.DataFrame) -> dict[int, list[tuple]]:
    out_of: dict[int, list] = {}
    for s, t, tb, c, e in _frames(edges, "s", "t", "tb", "c", "edge_id"):
        out_of.setdefault(s, []).append((t, tb, c, e))
    return out_of


def _label_cell(cell_blocks: int):
    def run(held: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(held) and len(edges):
            out_of, cell = _edges_by_node(edges), int(held["cell"].iloc[0])
            for trip, known in held.groupby("trip", sort=False):
                _, away = _labels_in_cell(known, out_of, cell, cell_blocks)
                m = int(known["m"].iloc[0])
                rows += [(trip, m, v, vb, *label) for v, (*label, vb) in away.items()]
        return frame(rows, [f.split()[0] for f in _LABEL.split(", ")])

    return run


_PIECE = "trip long, m int, at long, total_cost double, edge_ids array<string>, nodes array<long>"


def _walk_cell(cell_blocks: int):
    """Walks each trip back from the node it stands at until it leaves the cell or is at its source."""

    def run(held: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(held):
            out_of, cell = _edges_by_node(edges), int(held["cell"].iloc[0])
            for trip, known in held.groupby("trip", sort=False):
                best, _ = _labels_in_cell(known, out_of, cell, cell_blocks)
                at, source = int(known["at"].iloc[0]), int(known["source"].iloc[0])
                if at not in best:
                    continue
                total, ids, nodes = best[at][0], [], []
                while at != source and at in best:
                    _, _, edge, prior = best[at]
                    ids.append(edge)
                    nodes.append(at)
                    at = int(prior)
                rows.append((trip, int(known["m"].iloc[0]), at, total, ids[::-1], nodes[::-1]))
        return frame(rows, [f.split()[0] for f in _PIECE.split(", ")])

    return run


def place_nodes(edges: DataFrame, nodes: DataFrame | None, block_nodes: int, scratch: Scratch) -> DataFrame:
    """``(node, b)``: each edge end's block, along a curve through the plane or, without a place, by ascending ids."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    if nodes is None:
        order = ["node"]
    else:
        box = nodes.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
        west, south, width, height = (0.0, 0.0, 1.0, 1.0) if box[0] is None else (box[0], box[1], (box[2] - box[0]) * 1.000001 or 1.0, (box[3] - box[1]) * 1.000001 or 1.0)
        code = z_order((F.col("lon") - F.lit(west)) / F.lit(width), (F.col("lat") - F.lit(south)) / F.lit(height))
        at = nodes.filter("lon is not null and lat is not null").groupBy(F.col("node_id").cast("long").alias("node")).agg(F.min(code).alias("code"))
        ends = ends.join(unbroadcast(at), "node", "left")
        order = ["code", "node"]
    return scratch.write(gapless_rank(ends, [], order).select("node", F.expr(f"rank div {block_nodes}").cast("long").alias("b")))


class Overlay:
    """A graph cut into blocks, with the ways between their entries for each mode.

    ``edges`` has edge_id, source, target and a column for each mode, checked
    by the caller to be finite and not negative.  With ``nodes`` (node_id, lon,
    lat) blocks are stretches of a curve through the plane, without it, or for
    nodes it lacks, stretches of ascending ids.  ``places`` (node, b) are blocks that are known already.
    """

    def __init__(self, edges: DataFrame, modes: list[str], nodes: DataFrame | None = None, block_nodes: int = BLOCK_NODES, cell_blocks: int = CELL_BLOCKS, places: DataFrame | None = None):
        self.modes, self.cell_blocks = modes, cell_blocks
        self.scratch = scratch = Scratch(edges.sparkSession, "overlay")
        self.places = place_nodes(edges, nodes, block_nodes, scratch) if places is None else places
        priced = edges.select("edge_id", "source", "target", F.posexplode(F.array(*modes)).alias("m", "c"))
        put = lambda df, node, name: df.join(unbroadcast(self.places.select(F.col("node").alias(node), F.col("b").alias(name))), node)
        placed = put(put(priced, "source", "sb"), "target", "tb")
        self.edges = scratch.write(placed.select("m", F.col("source").alias("s"), F.col("target").alias("t"), "sb", "tb", "c", "edge_id").repartition("m", "sb"))
        entries = self.edges.filter("sb <> tb").select("m", F.col("tb").alias("sb"), "t").distinct()
        arcs = self.edges.groupBy("m", "sb").cogroup(entries.groupBy("m", "sb")).applyInPandas(_arcs_of_block, _ARC)
        self._unwritten = arcs

    @cached_property
    def arcs(self) -> DataFrame:
        """The ways between entries, worked out when they are first asked for."""
        return self.scratch.write(self._unwritten)

    def _cell(self, block: str) -> Column:
        return F.expr(f"{block} div {self.cell_blocks}").cast("long")

    def _batch(self) -> Column:
        return F.pmod(F.xxhash64("trip"), F.lit(self._batches))

    def _spread(self, start: DataFrame, arcs: DataFrame, bounds: DataFrame, ends: DataFrame | None, inside: DataFrame | None, max_rounds: int) -> tuple[DataFrame, DataFrame]:
        """Costs of entries up to each trip's bound, and the bounds, which fall where a trip meets its ``ends``.

        ``inside`` holds the entries that may be kept, with a cost ``f`` that
        counts against the bound.
        """
        scratch = self.scratch
        cell = lambda df: df.withColumns({"cell": self._cell("b"), "batch": self._batch()})
        least = F.min("cost").alias("cost")
        state = start.groupBy("trip", "m", "node", "b").agg(least).withColumn("new", F.lit(True))
        state, bounds = self._cut(state, bounds, ends, inside)
        grouped = arcs.withColumn("cell", self._cell("vb"))
        for _ in range(max_rounds):
            placed = cell(state)
            awake = scratch.write(placed.filter("new").select("m", "cell", "batch").distinct())
            if awake.isEmpty():
                return state, bounds
            held = placed.join(awake, ["m", "cell", "batch"], "left_semi").join(bounds, "trip")
            step = (
                held.groupBy("m", "cell", "batch")
                .cogroup(grouped.join(awake, ["m", "cell"]).groupBy("m", "cell", "batch"))
                .applyInPandas(_spread_cell(self.cell_blocks), _REACH)
            )
            at = lambda k: F.min(F.when(F.col("outside") == k, F.col("cost")))
            lower = lambda c: F.col(c).isNull() | (F.col("cost") < F.col(c))
            both = state.drop("new").withColumn("outside", F.lit(-1)).unionByName(step)
            merged = both.groupBy("trip", "m", "node", "b").agg(least, at(-1).alias("old"), at(0).alias("own"))
            merged = merged.select("trip", "m", "node", "b", "cost", (lower("old") & lower("own")).alias("new"))
            before = state
            state, bounds = self._cut(merged, bounds, ends, inside)
            scratch.drop(before)
            scratch.drop(awake)
        raise RuntimeError(f"distances did not settle within {max_rounds} rounds")

    def _cut(self, state: DataFrame, bounds: DataFrame, ends: DataFrame | None, inside: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Writes what stays within the bounds, after lowering them."""
        if inside is not None:
            within = state.join(inside, ["trip", "node"]).join(bounds, "trip").filter("f + cost <= most")
            return self.scratch.write(within.drop("f", "most")), bounds
        state = self.scratch.write(state)
        if ends is not None:
            met = state.join(ends, ["trip", "node"]).groupBy("trip").agg(F.min((F.col("cost") + F.col("rest")) * (1 + ROOM)).alias("met"))
            bounds = self.scratch.write(bounds.join(met, "trip", "left").select("trip", F.least("most", "met").alias("most")))
        return self.scratch.write(state.join(bounds, "trip").filter("cost <= most").drop("most")), bounds

    def paths(self, od: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
        """``(od_id, mode, found, total_cost, edge_ids, nodes)`` of rows (od_id, source, target) without nulls, for every mode.

        More than ``max_rounds`` rounds of one kind are an error: no path is cut.
        """
        scratch, spark = self.scratch, od.sparkSession
        ids = scratch.write(od.withColumn("trip", F.monotonically_increasing_id()))  # written, so that numbers stay
        n = ids.count()
        self.batch_trips(n)
        mode = F.explode(F.array(*[F.lit(i) for i in range(len(self.modes))])).alias("m")
        place = lambda node, name: self.places.select(F.col("node").alias(node), F.col("b").alias(name))
        trips = ids.filter("source <> target").select("trip", "source", "target", mode)
        trips = trips.withColumn("trip", F.col("trip") * len(self.modes) + F.col("m"))
        trips = scratch.write(trips.join(place("source", "sb"), "source").join(place("target", "tb"), "target").withColumn("batch", self._batch()))

        def met(key: str, kernel) -> DataFrame:
            few = scratch.write(trips.select("m", key, "batch").distinct())
            keys = ["m", key, "batch"]
            return scratch.write(trips.groupBy(*keys).cogroup(self.edges.join(few, ["m", key]).groupBy(*keys)).applyInPandas(kernel, _REACH))

        first, last = met("sb", _leave_block), met("tb", _reach_target)
        direct = first.filter("outside = 0").select("trip", (F.col("cost") * (1 + ROOM)).alias("most"))
        bounds = scratch.write(trips.select("trip").join(direct, "trip", "left").select("trip", F.coalesce("most", F.lit(float("inf"))).alias("most")))
        ends = last.select("trip", "node", F.col("cost").alias("rest"))
        reached, bounds = self._spread(first.filter("outside = 1").drop("outside"), self.arcs, bounds, ends, None, max_rounds)
        found = scratch.write(bounds.filter(F.col("most") < float("inf")))
        back = self.arcs.select("m", F.col("w").alias("v"), F.col("wb").alias("vb"), F.col("v").alias("w"), F.col("vb").alias("wb"), "c")
        inside = reached.select("trip", "node", F.col("cost").alias("f"))
        kept, _ = self._spread(last.drop("outside"), back, found, None, inside, max_rounds)

        going = trips.join(found, "trip")
        corridor = kept.select("trip", "m", "b").unionByName(going.select("trip", "m", F.explode(F.array("sb", "tb")).alias("b"))).distinct()
        whole = self.within(going, corridor, found, max_rounds)
        every = ids.select("od_id", "source", "target", "trip", mode).withColumn("trip", F.col("trip") * len(self.modes) + F.col("m"))
        same = F.col("source") == F.col("target")
        got = same | F.col("total_cost").isNotNull()
        return every.join(whole, "trip", "left").select(
            "od_id", F.array(*map(F.lit, self.modes))[F.col("m")].alias("mode"), got.alias("found"), F.when(same, F.lit(0.0)).otherwise(F.col("total_cost")).alias("total_cost"),
            F.coalesce("edge_ids", F.array().cast("array<string>")).alias("edge_ids"),
            F.when(got, F.concat(F.array("source"), F.coalesce("nodes", F.array().cast("array<long>")))).otherwise(F.array().cast("array<long>")).alias("nodes"),
        )

    def within(self, going: DataFrame, corridor: DataFrame, bounds: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
        """``(trip, edge_ids, nodes, total_cost)`` of the trips that have a path, from exact labels in their corridors (trip, m, b).

        ``going`` has trip, m, source, target and both ends' blocks sb and tb, ``bounds`` (trip, most) what no path may
        exceed; ``nodes`` starts after the source.
        """
        corridor = self.scratch.write(corridor.withColumns({"cell": self._cell("b"), "batch": self._batch()}))
        labels = self._labels(going, corridor, bounds, max_rounds)
        pieces = self._walk(going, labels, corridor, bounds, max_rounds)
        order = F.array_sort(F.collect_list(F.struct("nth", "edge_ids", "nodes", "total_cost")))
        return pieces.groupBy("trip").agg(order.alias("p")).select(
            "trip", F.flatten("p.edge_ids").alias("edge_ids"), F.flatten("p.nodes").alias("nodes"), F.element_at("p.total_cost", -1).alias("total_cost")
        )

    def batch_trips(self, n: int) -> None:
        self._batches = -(-n // BATCH_TRIPS) or 1

    def _edges_of(self, corridor: DataFrame, awake: DataFrame) -> DataFrame:
        """Edges that leave the corridors' blocks in the cells that are awake, once for each batch of trips."""
        blocks = corridor.join(awake, ["m", "cell", "batch"], "left_semi").select("m", F.col("b").alias("sb"), "cell", "batch").distinct()
        return self.edges.join(blocks, ["m", "sb"])

    def _labels(self, going: DataFrame, corridor: DataFrame, bounds: DataFrame, max_rounds: int) -> DataFrame:
        """The exact labels at which trips enter each cell of their corridor."""
        scratch = self.scratch
        zero = [F.lit(v).cast(t).alias(n) for v, t, n in zip(_START, ("double", "long", "string", "long"), ("cost", "level", "edge_id", "prior"), strict=True)]
        state = scratch.write(going.select("trip", "m", F.col("source").alias("node"), F.col("sb").alias("b"), *zero, F.lit(True).alias("new")))
        blocks = scratch.write(corridor.groupBy("trip", "cell").agg(F.collect_list("b").alias("blocks")))
        label = F.struct("cost", "level", "edge_id", "prior")
        for _ in range(max_rounds):
            placed = state.withColumns({"cell": self._cell("b"), "batch": self._batch()})
            awake = scratch.write(placed.filter("new").select("m", "cell", "batch").distinct())
            if awake.isEmpty():
                return state
            held = placed.join(awake, ["m", "cell", "batch"], "left_semi").join(bounds, "trip").join(blocks, ["trip", "cell"])
            step = held.groupBy("m", "cell", "batch").cogroup(self._edges_of(corridor, awake).groupBy("m", "cell", "batch")).applyInPandas(_label_cell(self.cell_blocks), _LABEL)
            step = step.join(corridor.select("trip", "b"), ["trip", "b"], "left_semi").withColumn("outside", F.lit(True))
            both = state.drop("new").withColumn("outside", F.lit(False)).unionByName(step)
            old = F.min(F.when(~F.col("outside"), F.struct("cost", "level"))).alias("old")
            merged = both.groupBy("trip", "m", "node", "b").agg(F.min(label).alias("l"), old)
            new = F.col("old").isNull() | (F.struct("l.cost", "l.level") < F.col("old"))
            before = state
            state = scratch.write(merged.select("trip", "m", "node", "b", "l.*", new.alias("new")))
            scratch.drop(before)
            scratch.drop(awake)
        raise RuntimeError(f"labels did not settle within {max_rounds} rounds")

    def _walk(self, going: DataFrame, labels: DataFrame, corridor: DataFrame, bounds: DataFrame, max_rounds: int) -> DataFrame:
        """``(trip, nth, edge_ids, nodes, total_cost)``: the parts of each path by cells, the last one with the path's cost."""
        scratch = self.scratch
        blocks = corridor.groupBy("trip", "cell").agg(F.collect_list("b").alias("blocks"))
        entered = scratch.write(labels.withColumns({"cell": self._cell("b")}).join(blocks, ["trip", "cell"]).join(bounds, "trip"))
        open_ = scratch.write(going.select("trip", "source", F.col("target").alias("at"), F.col("tb").alias("b")))
        parts: list[DataFrame] = []
        for nth in range(max_rounds):
            if open_.isEmpty():
                read = scratch.spark.read.schema(f"{_PIECE}, nth int")
                return read.parquet(*[p._scratch_path for p in parts]) if parts else scratch.spark.createDataFrame([], f"{_PIECE}, nth int")
            walkers = open_.select("trip", "source", "at", self._cell("b").alias("cell"))
            held = entered.join(walkers, ["trip", "cell"]).withColumn("batch", self._batch())
            awake = scratch.write(held.select("m", "cell", "batch").distinct())
            step = held.groupBy("m", "cell", "batch").cogroup(self._edges_of(corridor, awake).groupBy("m", "cell", "batch")).applyInPandas(_walk_cell(self.cell_blocks), _PIECE)
            parts.append(scratch.write(step.withColumn("nth", F.lit(-nth))))
            on = parts[-1].select("trip", "at").join(going.select("trip", "source"), "trip").filter("at <> source")
            before = open_
            open_ = scratch.write(on.join(self.places.select(F.col("node").alias("at"), "b"), "at").select("trip", "source", "at", "b"))
            scratch.drop(before)
        raise RuntimeError(f"paths were not walked back within {max_rounds} rounds")
