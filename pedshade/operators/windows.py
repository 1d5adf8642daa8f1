"""Shortest paths over graphs too large to broadcast, each trip in a window of its own.

Nodes are cut into tiles as in :mod:`pedshade.operators.overlay`.  A trip is
searched in the tiles around its two ends, together with the trips that start
near it, so a tile's edges move once for a group of trips.  Costs of edges over
their extents give a norm that no path undercuts; it leads the search to the
target and bounds every way out of the window.  A path is kept only when each
way out must cost more than it does.  Otherwise the trip is searched again in
all tiles that a path of the cost found can enter, which settles it, or, where
none was found, in a wider window.  Labels and ties are those of
:mod:`pedshade.operators.routing`.  What needs more than
``WINDOW_TILES`` tiles gets its labels from cell to cell, over the overlay's blocks.
"""

from __future__ import annotations

import math
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedshade.operators.overlay import BATCH_TRIPS, BLOCK_NODES, ROOM, Overlay, place_nodes
from pedshade.runtime import Scratch, unbroadcast

#: Tiles of one trip's window at most, of one that is grouped by both ends, and of one that is grouped by its source alone.
WINDOW_TILES, FAR_TILES, NEAR_TILES = 1280, 512, 25
#: Trips of the largest windows that a task takes at once.
WIDE_TRIPS = 4
#: Tiles in a row whose trips are searched together: short trips by their source, long ones by both ends.
NEAR_CELL, FAR_CELL = 16, 4
DIRECTIONS = 8
INF = float("inf")

_FOUND = "trip long, m int, certain boolean, total_cost double, edge_ids array<string>, nodes array<long>"
_FOUND_ARROW = pa.schema([("trip", pa.int64()), ("m", pa.int32()), ("certain", pa.bool_()), ("total_cost", pa.float64()), ("edge_ids", pa.list_(pa.string())), ("nodes", pa.list_(pa.int64()))])
_AXES = [(math.cos(k * math.pi / DIRECTIONS), math.sin(k * math.pi / DIRECTIONS)) for k in range(DIRECTIONS)]


class Window:
    """The loaded tiles' edges as compressed adjacency; an edge out of them has a head below zero."""

    def __init__(self, trips: pa.Table, edges: pa.Table, slopes: list[list[float]]):
        col = lambda t, n: t.column(n).to_numpy()
        src, dst = col(edges, "s"), col(edges, "t")
        inside = np.isin(col(edges, "tb"), np.array(trips.column("tiles")[0].as_py(), np.int64))
        ends = np.concatenate([col(trips, "source"), col(trips, "target")])
        self.nodes = np.unique(np.concatenate([src, dst[inside], ends]))
        s = np.searchsorted(self.nodes, src)
        order = np.argsort(s, kind="stable").astype(np.int32)  # a task's window has far less than 2^31 edges
        self.offsets = memoryview(np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(self.nodes)))]).astype(np.int64))
        dst, inside, tx, ty = dst[order], inside[order], col(edges, "tx")[order], col(edges, "ty")[order]
        heads = np.searchsorted(self.nodes, dst).astype(np.int32)
        x, y = np.zeros(len(self.nodes)), np.zeros(len(self.nodes))
        x[heads[inside]], y[heads[inside]] = tx[inside], ty[inside]
        for end, px, py in (("source", "sx", "sy"), ("target", "tx", "ty")):
            at = np.searchsorted(self.nodes, col(trips, end))
            x[at], y[at] = col(trips, px), col(trips, py)
        heads[~inside] = -1 - np.arange(np.count_nonzero(~inside), dtype=np.int32)
        self.sources, self.heads = memoryview(s[order].astype(np.int32)), memoryview(heads)
        self.ids = edges.column("edge_id").combine_chunks()
        self.order = order
        # Equal ids share a rank, which follows the ids' order.
        self.rank = memoryview(pc.rank(self.ids, tiebreaker="dense").to_numpy().astype(np.int32)[order]) if len(self.ids) else memoryview(np.zeros(0, np.int32))
        # Only the modes that these trips want.
        wanted = {m for modes in trips.column("modes").to_pylist() for m in modes}
        self.costs = {m: memoryview(np.ascontiguousarray(col(edges, f"c{m}")[order])) for m in wanted}
        self.slopes, self.places, self.away = slopes, (x, y), (tx[~inside], ty[~inside])

    def _rest(self, m: int, target: int, x: np.ndarray, y: np.ndarray) -> memoryview:
        """What a path of a mode from each place to a node costs at least."""
        dx, dy = x - self.places[0][target], y - self.places[1][target]
        least = np.zeros(len(x))
        for k, (u, v) in zip(self.slopes[m], _AXES, strict=True):
            np.maximum(least, np.abs(k * (u * dx + v * dy)), out=least)
        return memoryview(least)

    def index(self, node: int) -> int:
        return int(np.searchsorted(self.nodes, node))

    def search(self, m: int, source: int, target: int) -> tuple[bool, float | None, list[int]]:
        """Whether the answer holds for the whole graph, the cost (None: no path) and the path's slots."""
        rest, beyond = self._rest(m, target, *self.places), self._rest(m, target, *self.away)
        offsets, heads, rank, cost = self.offsets, self.heads, self.rank, self.costs[m]
        # Labels (cost, level, edge rank) and the slot of the last edge, as plain arrays: a window can hold a million nodes.
        n = len(self.nodes)
        costs, levels, ranks, last = array("d", [INF]) * n, array("i", [0]) * n, array("i", [-1]) * n, array("i", [-1]) * n
        costs[source] = 0.0
        heap = [(rest[source], 0.0, 0, source)]
        bound = leak = INF
        while heap:
            f, d, level, u = heappop(heap)
            if f > bound:
                break
            known = costs[u]
            if d > known or (d == known and level > levels[u]):
                continue
            for e in range(offsets[u], offsets[u + 1]):
                c, v = d + cost[e], heads[e]
                if v < 0:
                    leak = min(leak, c + beyond[-1 - v])
                    continue
                f = c + rest[v]
                if f > bound:
                    continue
                old = costs[v]
                if c > old:
                    continue
                next_level = level + 1 if c == d else 0
                if c < old or (next_level, rank[e]) < (levels[v], ranks[v]):
                    ahead = c < old or next_level < levels[v]
                    costs[v], levels[v], ranks[v], last[v] = c, next_level, rank[e], e
                    if v == target:
                        bound = c * (1 + ROOM)
                    elif ahead:
                        heappush(heap, (f, c, next_level, v))
        certain = leak == INF or leak > bound
        if costs[target] == INF:
            return certain, None, []
        slots, at = [], target
        while at != source:
            slots.append(last[at])
            at = self.sources[last[at]]
        return certain, costs[target], slots[::-1]


def _search_group(slopes: list[list[float]]):
    def run(trips: pa.Table, edges: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(trips):
            w = Window(trips, edges, slopes)
            for trip, modes, source, target in zip(*(trips.column(c).to_pylist() for c in ("trip", "modes", "source", "target")), strict=True):
                for m in modes:
                    certain, cost, slots = w.search(m, w.index(source), w.index(target))
                    ids = w.ids.take(pa.array(w.order[slots])).to_pylist() if slots else []
                    heads = [int(w.nodes[w.heads[e]]) for e in slots]
                    rows.append((trip, m, certain, cost, ids, [source, *heads] if cost is not None else []))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_FOUND_ARROW), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

    return run


class Windows:
    """A graph cut into tiles.  ``edges`` has edge_id, source, target and a column of checked costs for each mode."""

    def __init__(self, edges: DataFrame, modes: list[str], nodes: DataFrame, block_nodes: int = BLOCK_NODES):
        self.modes, self.given, self.nodes, self.block_nodes = modes, edges, nodes, block_nodes
        self.scratch = scratch = Scratch(edges.sparkSession, "windows")
        where = nodes.filter("lon is not null and lat is not null").groupBy(F.col("node_id").cast("long").alias("node")).agg(F.min(F.struct("lon", "lat")).alias("p"))
        box = where.agg(F.min("p.lon"), F.min("p.lat"), F.max("p.lon"), F.max("p.lat"), F.count(F.lit(1))).first()
        self.whole = bool(box[4])
        if not self.whole:
            return
        # Degrees of longitude are as long as those of latitude, from the graph's corner.
        shrink = math.cos(math.radians((box[1] + box[3]) / 2)) or 1.0
        where = where.select("node", ((F.col("p.lon") - F.lit(box[0])) * F.lit(shrink)).alias("x"), (F.col("p.lat") - F.lit(box[1])).alias("y"))
        self.width, self.height = (box[2] - box[0]) * shrink, box[3] - box[1]
        places = place_nodes(edges, nodes, block_nodes, scratch).join(unbroadcast(where), "node", "left")
        self.places = scratch.write(places)
        end = lambda node, b, x, y: self.places.select(F.col("node").alias(node), F.col("b").alias(b), F.col("x").alias(x), F.col("y").alias(y))
        placed = edges.join(unbroadcast(end("source", "sb", "sx", "sy")), "source").join(unbroadcast(end("target", "tb", "tx", "ty")), "target")
        costs = [F.col(c).alias(f"c{m}") for m, c in enumerate(modes)]
        placed = placed.select("sb", F.col("source").alias("s"), F.col("target").alias("t"), "tb", "sx", "sy", "tx", "ty", *costs, "edge_id")
        written = scratch.write(placed.repartition("sb"))
        extent = lambda u, v: F.abs((F.col("tx") - F.col("sx")) * F.lit(u) + (F.col("ty") - F.col("sy")) * F.lit(v))
        least = [F.min(F.try_divide(F.col(f"c{m}"), extent(u, v))).alias(f"k{m}_{i}") for m in range(len(modes)) for i, (u, v) in enumerate(_AXES)]
        seen = written.agg(F.count_if(F.col("sx").isNull() | F.col("tx").isNull()).alias("lost"), *least).first()
        # A node without a place could be anywhere: the overlay takes such a graph.
        self.whole = not seen["lost"]
        slope = lambda k: (k if k is not None and math.isfinite(k) else 0.0) * (1 - ROOM)
        self.slopes = [[slope(seen[f"k{m}_{i}"]) for i in range(len(_AXES))] for m in range(len(modes))]
        self.edges = written.drop("sx", "sy")
        tiles = self.places.groupBy("b").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))
        n = max(1, self.places.count() // block_nodes)
        self.side = math.sqrt(self.width * self.height / n) or max(self.width, self.height, 1e-9) / n
        self.tiles = scratch.write(tiles.withColumn("cell", F.explode(self._cells(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")))))

    def _cells(self, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
        """Squares of two tiles' width that a box touches, inside the graph's own box."""
        size = 2 * self.side
        at = lambda v, most: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(most)) / F.lit(size)).cast("long")
        xs, ys = (F.sequence(at(a, most), at(b, most)) for a, b, most in ((x0, x1, self.width), (y0, y1, self.height)))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))

    def _gap(self, x: str, y: str, slopes: list[Column]) -> Column:
        """The norm's least value between a point and a tile's box."""
        mid = lambda a, b: (F.col(a) + F.col(b)) / 2
        half = lambda a, b: (F.col(b) - F.col(a)) / 2
        gaps = []
        for k, (u, v) in zip(slopes, _AXES, strict=True):
            off = F.abs((F.col(x) - mid("x0", "x1")) * F.lit(u) + (F.col(y) - mid("y0", "y1")) * F.lit(v))
            gaps.append(k * (off - half("x0", "x1") * F.lit(abs(u)) - half("y0", "y1") * F.lit(abs(v))))
        return F.greatest(F.lit(0.0), *gaps)

    def _windows(self, trips: DataFrame) -> DataFrame:
        """``(trip, m, b)``: tiles that touch the box around a trip's ends, wider by px and py, and that a path of cost ``most`` can enter."""
        low = lambda a, b, p: F.least(a, b) - F.col(p)
        high = lambda a, b, p: F.greatest(a, b) + F.col(p)
        box = trips.withColumns({"bx0": low("sx", "tx", "px"), "bx1": high("sx", "tx", "px"), "by0": low("sy", "ty", "py"), "by1": high("sy", "ty", "py")})
        box = box.withColumn("cell", F.explode(self._cells(F.col("bx0"), F.col("bx1"), F.col("by0"), F.col("by1"))))
        met = box.join(self.tiles, "cell").filter("x1 >= bx0 and x0 <= bx1 and y1 >= by0 and y0 <= by1")
        slopes = [F.array(*[F.lit(mode[i]) for mode in self.slopes])[F.col("m")] for i in range(len(_AXES))]
        met = met.filter(F.col("most").isNull() | (self._gap("sx", "sy", slopes) + self._gap("tx", "ty", slopes) <= F.col("most")))
        return met.select("trip", "m", "b").distinct()

    def _far(self, rest: DataFrame) -> DataFrame:
        """Paths of trips whose windows are too large for a task, by labels that go from cell to cell of the overlay."""
        graph = Overlay(self.given, self.modes, self.nodes, self.block_nodes, places=self.places.select("node", "b"))
        graph.batch_trips(rest.count())
        n = len(self.modes)
        going = self.scratch.write(rest.select((F.col("trip") * n + F.col("m")).alias("trip"), "m", "source", "target", "sb", "tb", F.coalesce("most", F.lit(INF)).alias("most"), "tiles"))
        every = self.tiles.select("b").distinct()
        corridor = going.filter("tiles is not null").select("trip", "m", F.explode("tiles").alias("b"))
        corridor = corridor.unionByName(going.filter("tiles is null").select("trip", "m").crossJoin(every))  # a row for each tile, not node
        whole = graph.within(going.drop("most", "tiles"), corridor.distinct(), going.select("trip", "most"))
        ends = going.select("trip", "m", "source")
        nodes = F.concat(F.array("source"), "nodes")
        return whole.join(ends, "trip").select(F.expr(f"trip div {n}").alias("trip"), "m", F.lit(True).alias("certain"), "total_cost", "edge_ids", nodes.alias("nodes"))

    def paths(self, od: DataFrame) -> DataFrame:
        """``(od_id, mode, found, total_cost, edge_ids, nodes)`` of rows (od_id, source, target) without nulls, for every mode."""
        if not self.whole:
            return Overlay(self.given, self.modes, self.nodes, self.block_nodes).paths(od)
        scratch = self.scratch
        ids = scratch.write(od.withColumn("trip", F.monotonically_increasing_id()))
        end = lambda node, b, x, y: self.places.select(F.col("node").alias(node), F.col("b").alias(b), F.col("x").alias(x), F.col("y").alias(y))
        trips = ids.filter("source <> target").join(end("source", "sb", "sx", "sy"), "source").join(end("target", "tb", "tx", "ty"), "target")
        modes = F.explode(F.array(*[F.lit(i) for i in range(len(self.modes))])).alias("m")
        pad = (F.abs(F.col("tx") - F.col("sx")) + F.abs(F.col("ty") - F.col("sy"))) * 0.08 + F.lit(0.1 * self.side)
        left = trips.select("trip", "source", "target", "sb", "tb", "sx", "sy", "tx", "ty", modes, pad.alias("px"), pad.alias("py"), F.lit(None).cast("double").alias("most"))
        left = scratch.write(left)
        settled: list[DataFrame] = []
        beyond: list[DataFrame] = []
        while not left.isEmpty():
            windows = scratch.write(self._windows(left))
            sizes = windows.groupBy("trip", "m").agg(F.count(F.lit(1)).alias("n_tiles"))
            sized = scratch.write(left.join(sizes, ["trip", "m"], "left"))
            far = F.coalesce(F.col("n_tiles") > WINDOW_TILES, F.lit(True))
            # What a path of a known cost can enter is its corridor; without one it may enter any tile.
            wide = sized.filter(far).select("trip", "m", "source", "target", "sb", "tb", "most")
            known = windows.groupBy("trip", "m").agg(F.collect_list("b").alias("tiles"))
            beyond.append(wide.join(known, ["trip", "m"], "left").withColumn("tiles", F.when(F.col("most").isNotNull(), F.col("tiles"))))
            near = F.col("n_tiles") <= NEAR_TILES
            wide = F.col("n_tiles") > FAR_TILES
            group = F.struct(
                F.when(near, F.expr(f"sb div {NEAR_CELL}")).when(wide, F.lit(-1)).otherwise(F.expr(f"sb div {FAR_CELL}")).cast("long").alias("a"),
                F.when(near | wide, F.lit(-1)).otherwise(F.expr(f"tb div {FAR_CELL}")).cast("long").alias("z"),
            )
            going = sized.filter(~far).withColumn("g", group)
            counted = going.groupBy("g").agg(F.count_distinct("trip").alias("n_trips"))
            most = F.when(F.col("g.a") < 0, WIDE_TRIPS).otherwise(BATCH_TRIPS)
            batch = F.pmod(F.xxhash64("trip"), F.ceil(F.col("n_trips") / most).cast("long"))
            going = scratch.write(going.join(counted, "g").withColumn("g", F.struct("g.a", "g.z", batch.alias("k"))))
            tiles = windows.join(going.select("trip", "m", "g"), ["trip", "m"]).select("g", "b").distinct()
            tiles = scratch.write(tiles)
            lists = tiles.groupBy("g").agg(F.collect_list("b").alias("tiles"))
            # One row a trip; the group's tiles stand on all of its rows, as any may come first.
            rows = going.groupBy("g", "trip", "source", "target", "sx", "sy", "tx", "ty").agg(F.collect_list("m").alias("modes")).join(lists, "g")
            edges = self.edges.join(tiles.withColumnRenamed("b", "sb"), "sb")
            out = scratch.write(rows.groupBy("g").cogroup(edges.groupBy("g")).applyInArrow(_search_group(self.slopes), _FOUND))
            settled.append(out.filter("certain"))
            open_ = out.filter("not certain").select("trip", "m", (F.col("total_cost") * (1 + ROOM)).alias("cost"))
            again = going.select("trip", "source", "target", "sb", "tb", "sx", "sy", "tx", "ty", "m", "px", "py").join(open_, ["trip", "m"])
            # A path of the cost found leaves the box by so much at most; without one the window widens.
            of_mode = lambda i: F.array(*[F.lit(mode[i]) for mode in self.slopes])[F.col("m")]
            reach = lambda i, a, b, most: F.least(F.lit(most), F.coalesce((F.try_divide(F.col("cost"), of_mode(i)) - F.abs(F.col(a) - F.col(b))) / 2, F.lit(most)))
            px = F.when(F.col("cost").isNull(), F.col("px") * 4 + F.lit(self.side)).otherwise(reach(0, "sx", "tx", self.width) + F.lit(1e-9))
            py = F.when(F.col("cost").isNull(), F.col("py") * 4 + F.lit(self.side)).otherwise(reach(DIRECTIONS // 2, "sy", "ty", self.height) + F.lit(1e-9))
            left = scratch.write(again.select("trip", "source", "target", "sb", "tb", "sx", "sy", "tx", "ty", "m", px.alias("px"), py.alias("py"), F.col("cost").alias("most")))
        every = ids.select("od_id", "source", "target", "trip", modes)
        got = None
        for part in settled:
            got = part if got is None else got.unionByName(part)
        rest = None
        for part in beyond:
            rest = part if rest is None else rest.unionByName(part)
        if rest is not None:
            rest = scratch.write(rest)
            if not rest.isEmpty():
                got = got.unionByName(self._far(rest))
        same = F.col("source") == F.col("target")
        found = same | F.col("total_cost").isNotNull()
        nothing = lambda kind: F.array().cast(f"array<{kind}>")
        whole = every.join(got.drop("certain"), ["trip", "m"], "left") if got is not None else every.select("*", F.lit(None).cast("double").alias("total_cost"), nothing("string").alias("edge_ids"), nothing("long").alias("nodes"))
        return whole.select(
            "od_id", F.array(*map(F.lit, self.modes))[F.col("m")].alias("mode"), found.alias("found"), F.when(same, F.lit(0.0)).otherwise(F.col("total_cost")).alias("total_cost"),
            F.coalesce("edge_ids", nothing("string")).alias("edge_ids"), F.when(same, F.array("source")).otherwise(F.coalesce("nodes", nothing("long"))).alias("nodes"),
        )
