"""Costs from many sources to all nodes of a graph that no executor holds whole.

Nodes are cut into tiles as in :mod:`pedshade.operators.overlay`, and a number of
tiles in a row is a cell, what one task reads at a time.  For every tile the
costs from its entries, nodes that an edge from another tile leads to, to its
exits are worked out once.  Costs of a batch of sources then go from cell to
cell in rounds, as arrays with a row for each entry and a column for each
source; only what fell moves on.  At last each cell is filled, tile by tile.
No task holds more than a cell and its entries' costs of one batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedshade.operators.overlay import MAX_ROUNDS, place_nodes
from pedshade.operators.ranks import gapless_rank
from pedshade.runtime import Scratch, unbroadcast

#: Sources whose costs a task takes through a cell at once, and numbers of one product's block.
BATCH_SOURCES, CACHED = 1024, 32_768
#: Products grow with a tile's entries, rounds inside a cell with its tiles: small tiles, many to a cell.
TILE_NODES, CELL_TILES = 512, 32
MAX_TASKS = 4096
INF = float("inf")

_CELL = "cell long, held binary"
#: Costs at nodes that a cell is entered by: ``state`` is what it knows, else what came from another cell.
_COSTS = "batch int, cell long, state boolean, nodes binary, columns binary, costs binary"
_COSTS_ARROW = pa.schema([("batch", pa.int32()), ("cell", pa.int64()), ("state", pa.bool_()), ("nodes", pa.binary()), ("columns", pa.binary()), ("costs", pa.binary())])
_ROWS_ARROW = pa.schema([("source", pa.int64()), ("node", pa.int64()), ("cost", pa.float64())])


def _min_plus(costs: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """The least of ``costs[k, j] + ways[k, i]`` over k, by (i, j), a block that stays in the processor's cache at a time."""
    out = np.full((ways.shape[1], costs.shape[1]), INF)
    wide = max(16, CACHED // max(1, ways.shape[1]))
    for at in range(0, costs.shape[1], wide):
        part = np.ascontiguousarray(costs[:, at : at + wide])
        block = np.full((ways.shape[1], part.shape[1]), INF)
        room = np.empty_like(block)
        for k in range(len(part)):
            np.add(ways[k][:, None], part[k], out=room)
            np.minimum(block, room, out=block)
        out[:, at : at + wide] = block
    return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, where each key starts in it, and the distinct keys."""
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    return order, first, distinct


class Tile:
    """A tile's nodes, entries and exits, and its inner edges in slots: one edge into a node each."""

    def __init__(self, nodes: np.ndarray, entries: np.ndarray, exits: np.ndarray, s: np.ndarray, t: np.ndarray, c: np.ndarray):
        self.nodes, self.entries, self.exits = nodes, entries, exits
        s, t = np.searchsorted(nodes, s), np.searchsorted(nodes, t)
        order = np.lexsort((c, t))
        s, t, c = s[order].astype(np.int32), t[order].astype(np.int32), c[order]
        nth = np.arange(len(t)) - np.searchsorted(t, t)
        self.slots = [(s[nth == k], t[nth == k], c[nth == k]) for k in range(int(nth.max(initial=-1)) + 1)]
        self.ways = self.from_nodes(entries)[np.searchsorted(nodes, exits)].T.copy()

    def from_nodes(self, starts: np.ndarray) -> np.ndarray:
        """Costs inside the tile, by (node, start)."""
        best = np.full((len(self.nodes), len(starts)), INF)
        best[np.searchsorted(self.nodes, starts), np.arange(len(starts))] = 0.0
        while True:
            before = best.copy()
            for _ in range(4):
                for s, t, c in self.slots:
                    best[t] = np.minimum(best[t], best[s] + c[:, None])
            if np.array_equal(before, best):
                return best


class Cell:
    """Tiles of a cell and the edges between them and out of the cell."""

    def __init__(self, cell: int, cell_blocks: int, s: np.ndarray, t: np.ndarray, sb: np.ndarray, tb: np.ndarray, c: np.ndarray):
        from_here, to_here = sb // cell_blocks == cell, tb // cell_blocks == cell
        self.tiles: list[Tile] = []
        for b in np.unique(np.concatenate([sb[from_here], tb[to_here]])):
            of, to = sb == b, tb == b
            inner = of & to
            self.tiles.append(Tile(np.unique(np.concatenate([s[of], t[to]])), np.unique(t[to & ~of]), np.unique(s[of & ~to]), s[inner], t[inner], c[inner]))
        # Places of all entries and exits, tile after tile.
        size = lambda name: np.concatenate([[0], np.cumsum([len(getattr(x, name)) for x in self.tiles])]).astype(np.int64)
        self.entry_at, self.exit_at = size("entries"), size("exits")
        entries, exits = np.concatenate([x.entries for x in self.tiles]), np.concatenate([x.exits for x in self.tiles])
        self.by_node = np.argsort(entries, kind="stable")
        self.entries = entries[self.by_node]
        cross = from_here & (sb != tb)
        place = np.argsort(exits, kind="stable")
        z = place[np.searchsorted(exits[place], s[cross])]
        t, tc, c = t[cross], tb[cross] // cell_blocks, c[cross]
        tile = np.searchsorted(self.exit_at, z, side="right") - 1
        self.inner = []
        for k in range(len(self.tiles)):
            of = (tile == k) & (tc == cell)
            order, first, to = _groups(self.places(t[of]))
            self.inner.append((z[of][order] - self.exit_at[k], c[of][order], first, to))
        self.out = []
        for other in np.unique(tc[tc != cell]):
            of = tc == other
            order, first, to = _groups(t[of])
            self.out.append((int(other), z[of][order], c[of][order], first, to))

    def places(self, nodes: np.ndarray) -> np.ndarray:
        return self.by_node[np.searchsorted(self.entries, nodes)]

    def spread(self, best: np.ndarray, nodes: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Lowers the entries' costs to rest, from those given and from sources ``nodes``; returns the exits' costs."""
        ends = np.full((int(self.exit_at[-1]), best.shape[1]), INF)
        fresh = best.copy()

        def push(k: int, cols: np.ndarray, costs: np.ndarray) -> None:
            rows = slice(self.exit_at[k], self.exit_at[k + 1])
            known = ends[rows][:, cols]
            lower = costs < known
            if not lower.any():
                return
            ends[rows, cols] = np.minimum(known, costs)
            z, c, first, to = self.inner[k]
            if len(z):
                costs = np.minimum.reduceat(np.where(lower, costs, INF)[z] + c[:, None], first, axis=0)
                at = np.ix_(to, cols)
                lower = costs < best[at]
                best[at] = np.where(lower, costs, best[at])
                fresh[at] = np.where(lower, costs, fresh[at])

        for k, x in enumerate(self.tiles):
            here = np.flatnonzero(np.isin(nodes, x.nodes))
            if len(here) and len(x.exits):
                push(k, columns[here], x.from_nodes(nodes[here])[np.searchsorted(x.nodes, x.exits)])
        while True:
            awake = False
            for k, x in enumerate(self.tiles):
                rows = slice(self.entry_at[k], self.entry_at[k + 1])
                moved = fresh[rows] < INF
                some, cols = np.flatnonzero(moved.any(axis=1)), np.flatnonzero(moved.any(axis=0))
                if len(some):
                    awake = True
                    costs = fresh[rows][np.ix_(some, cols)]
                    fresh[rows] = INF
                    push(k, cols, _min_plus(costs, x.ways[some]))
            if not awake:
                return ends

    def fill(self, best: np.ndarray, nodes: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, costs by node and column) of each tile."""
        self.spread(best, nodes, columns)
        for k, x in enumerate(self.tiles):
            costs = _min_plus(best[self.entry_at[k] : self.entry_at[k + 1]], x.from_nodes(x.entries).T)
            here = np.flatnonzero(np.isin(nodes, x.nodes))
            if len(here):
                costs[:, columns[here]] = np.minimum(costs[:, columns[here]], x.from_nodes(nodes[here]))
            yield x.nodes, costs


def _build_cell(cell_blocks: int):
    def run(key: tuple[pa.Scalar, ...], edges: pa.Table) -> pa.Table:
        col = lambda n: edges.column(n).to_numpy()
        held = Cell(key[0].as_py(), cell_blocks, *(col(n) for n in ("s", "t", "sb", "tb", "c")))
        return pa.table({"cell": [key[0].as_py()], "held": [pickle.dumps(held, protocol=5)]})

    return run


def _visit(n_sources: int, batches: int):
    """Takes what came to a cell through it: its new state, and what goes on to other cells."""

    def run(costs: pa.Table, cells: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(costs) and len(cells):
            cell: Cell = pickle.loads(cells.column("held")[0].as_py())
            batch, at = costs.column("batch")[0].as_py(), cells.column("cell")[0].as_py()
            width = -(-(n_sources - batch) // batches)
            known = np.full((len(cell.entries), width), INF)
            came = known.copy()
            nodes, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for state, ids, cols, values in zip(*(costs.column(c).to_pylist() for c in ("state", "nodes", "columns", "costs")), strict=True):
                ids, cols = np.frombuffer(ids, np.int64), np.frombuffer(cols, np.int64)
                if values is None:
                    nodes.append(ids)
                    columns.append(cols)
                    continue
                where = np.ix_(cell.places(ids), cols)
                into = known if state else came
                into[where] = np.minimum(into[where], np.frombuffer(values).reshape(len(ids), len(cols)))
            came[came >= known] = INF
            known = np.minimum(known, came)
            ends = cell.spread(came, np.concatenate(nodes), np.concatenate(columns))
            met = np.flatnonzero((known < INF).any(axis=1))
            if len(met):
                ids = np.empty(len(cell.entries), np.int64)
                ids[cell.by_node] = cell.entries
                rows.append((batch, at, True, ids[met].tobytes(), np.arange(width).tobytes(), known[met].tobytes()))
            for other, z, c, first, to in cell.out:
                out = np.minimum.reduceat(ends[z] + c[:, None], first, axis=0)
                cols = np.flatnonzero((out < INF).any(axis=0))
                if len(cols):
                    rows.append((batch, other, False, to.astype(np.int64).tobytes(), cols.astype(np.int64).tobytes(), np.ascontiguousarray(out[:, cols]).tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_COSTS_ARROW), _COSTS_ARROW, strict=True)], schema=_COSTS_ARROW)

    return run


def _fill_cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for held, sources, nodes, ids, costs in zip(*(part.column(part.schema.names.index(c)) for c in ("held", "sources", "starts", "nodes", "costs")), strict=True):
            cell: Cell = pickle.loads(held.as_py())
            sources = np.array(sources.as_py(), np.int64)
            best = np.full((len(cell.entries), len(sources)), INF)
            if ids.is_valid:
                at = np.frombuffer(ids.as_py(), np.int64)
                best[cell.places(at)] = np.frombuffer(costs.as_py()).reshape(len(at), len(sources))
            here = np.array(nodes.as_py() or [], np.int64)
            order = np.argsort(sources, kind="stable")
            for found, values in cell.fill(best, here, order[np.searchsorted(sources[order], here)]):
                at, of = np.nonzero(values < INF)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(sources[of]), pa.array(found[at]), pa.array(values[at, of])], schema=_ROWS_ARROW)


def tiled_trees(edges: DataFrame, sources: DataFrame, nodes: DataFrame, block_nodes: int = TILE_NODES, cell_blocks: int = CELL_TILES, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(source, node, cost)`` of all nodes reachable from each of ``sources``.

    ``edges`` has source, target and a cost that is checked to be finite and
    not negative; ``nodes`` (node_id, lon, lat) places them.  Costs are sums
    along a path by parts, so their last bits may differ from sums edge by
    edge.  More than ``max_rounds`` rounds are an error: no tree is cut.
    """
    scratch = Scratch(edges.sparkSession, "trees")
    places = place_nodes(edges, nodes, block_nodes, scratch)
    put = lambda df, node, b: df.join(unbroadcast(places.select(F.col("node").alias(node), F.col("b").alias(b))), node)
    cell = lambda b: F.expr(f"{b} div {cell_blocks}").cast("long")
    placed = put(put(edges.select("source", "target", F.col("cost").alias("c")), "source", "sb"), "target", "tb")
    # An edge between cells goes to both.
    ways = placed.select(F.explode(F.array_distinct(F.array(cell("sb"), cell("tb")))).alias("cell"), F.col("source").alias("s"), F.col("target").alias("t"), "sb", "tb", "c")
    # Groups are few and take long, so each gets a task of its own, whatever its bytes.
    spread = lambda df, n, *keys: df.repartition(max(1, min(n, MAX_TASKS)), *keys).groupBy(*keys)
    n_cells = (places.agg(F.max("b")).first()[0] or 0) // cell_blocks + 1
    cells = scratch.write(spread(ways, n_cells, "cell").applyInArrow(_build_cell(cell_blocks), _CELL))
    wanted = sources.select(F.col("source").cast("long").alias("source")).filter("source is not null").distinct()
    met = scratch.write(gapless_rank(wanted.join(places.select(F.col("node").alias("source"), "b"), "source"), [], ["source"]))
    n = met.count()
    batches = -(-n // BATCH_SOURCES) or 1
    starts = scratch.write(met.select(F.expr(f"rank % {batches}").cast("int").alias("batch"), F.expr(f"rank div {batches}").alias("column"), cell("b").alias("cell"), "source"))
    alone = wanted.join(met.select("source"), "source", "left_anti").select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"))

    def packed(keyed):
        def run(rows: pa.Table) -> pa.Table:
            order = rows.sort_by("column")
            ids, cols = (order.column(c).to_numpy().astype(np.int64).tobytes() for c in ("source", "column"))
            return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip((rows.column("batch")[0].as_py(), rows.column("cell")[0].as_py(), False, ids, cols, None), _COSTS_ARROW, strict=True)], schema=_COSTS_ARROW)

        return keyed.applyInArrow(run, _COSTS)

    moved = scratch.write(packed(starts.groupBy("batch", "cell")))
    states = None
    keys = ["batch", "cell"]
    for _ in range(max_rounds):
        awake = scratch.write(moved.filter("not state").select(*keys).distinct())
        n_awake = awake.count()
        if not n_awake:
            break
        held = moved.filter("not state")
        if states is not None:
            held = held.unionByName(states.join(F.broadcast(awake), keys, "left_semi"))
        right = cells.join(F.broadcast(awake), "cell")
        out = scratch.write(spread(held, n_awake, *keys).cogroup(spread(right, n_awake, *keys)).applyInArrow(_visit(n, batches), _COSTS))
        after = out.filter("state")
        if states is not None:
            after = after.unionByName(states.join(F.broadcast(awake), keys, "left_anti"))
        before, states = states, scratch.write(after)
        scratch.drop(moved)
        if before is not None:
            scratch.drop(before)
        moved = out
    else:
        raise RuntimeError(f"costs did not settle within {max_rounds} rounds")
    if states is None:
        return alone
    every = starts.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "source"))), lambda x: x["source"]).alias("sources"))
    own = starts.groupBy(*keys).agg(F.collect_list("source").alias("starts"))
    # A row for each cell and batch, a task for each few of them.
    rows = cells.crossJoin(every).join(own, keys, "left").join(states.drop("state", "columns"), keys, "left")
    whole = rows.repartition(min(n_cells * batches, MAX_TASKS), *keys).mapInArrow(_fill_cells, "source long, node long, cost double")
    return whole.unionByName(alone)
