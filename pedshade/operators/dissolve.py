"""Unions, differences and repaired outlines of polygons, as polygons with holes.

The plane is swept in strips between neighbouring ordinates of vertices and
crossings.  No two edges cross inside a strip, so what belongs to the result
there is a row of trapezoids; their sides, and the stretches of an ordinate
with the result on one side only, are its border and close to rings whatever
the rounding.  On Spark a layer is cut to squares first, and the polygons of a
square are united in a tree of bounded batches.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedshade.operators.cover import FRAGMENT_M, POLYGON, _rings, footprints, rings_box, shadow_polygons, shipped
from pedshade.operators.polygons import Rings, _edges, _heights, inside
from pedshade.operators.spatial import cells_of
from pedshade.runtime import Scratch, frame

#: Decimals of a coordinate; gaps and slivers below one unit of them vanish.
DIGITS = 9
#: Polygons that are united at once.
BATCH = 64

Point = tuple[float, float]
Span = tuple[float, float]


def union(a: bool, b: bool) -> bool:
    return a or b


def common(a: bool, b: bool) -> bool:
    return a and b


def difference(a: bool, b: bool) -> bool:
    return a and not b


# -- the planar kernel -------------------------------------------------------------------


def _levels(below: list[Span], above: list[Span], y: float) -> list[tuple[Point, Point, int]]:
    """The stretches of an ordinate with the result on one side only, that side on their left."""
    change: dict[float, list[int]] = defaultdict(lambda: [0, 0])
    for k, spans in enumerate((below, above)):
        for s, e in spans:
            change[s][k] += 1
            change[e][k] -= 1
    marks = sorted(change)
    out, under, over = [], 0, 0
    for x, following in zip(marks[:-1], marks[1:], strict=True):
        under += change[x][0]
        over += change[x][1]
        if under and not over:
            out.append(((following, y), (x, y), -1))
        elif over and not under:
            out.append(((x, y), (following, y), -1))
    return out


def _border(sides: list[tuple[int, Rings]], keep: Callable[[bool, bool], bool], digits: int) -> list[tuple[Point, Point, int]]:
    """Directed stretches ``(from, to, edge)`` of the result's border, the result on their left."""
    grain = 10.0**-digits
    parts = [_edges(r) for _, r in sides]
    p, q = (np.concatenate(x) for x in zip(*parts, strict=True))
    sizes = [len(a) for a, _ in parts]
    owner = np.repeat(np.arange(len(sides)), sizes)
    side = np.repeat([s for s, _ in sides], sizes)
    slanted = p[:, 1] != q[:, 1]
    p, q, owner, side = p[slanted], q[slanted], owner[slanted], side[slanted]
    if not len(p):
        return []
    up = (p[:, 1] < q[:, 1])[:, None]
    low, high = np.where(up, p, q), np.where(up, q, p)  # a shared edge gives the same numbers either way round
    slope = (high[:, 0] - low[:, 0]) / (high[:, 1] - low[:, 1])
    ys = np.unique(np.round(_heights([r for _, r in sides]), digits))
    out: list[tuple[Point, Point, int]] = []
    before: list[Span] = []
    for lo, hi in zip(ys[:-1].tolist(), ys[1:].tolist(), strict=True):
        on = np.flatnonzero((low[:, 1] <= lo) & (high[:, 1] >= hi))
        mid = low[on, 0] + ((lo + hi) / 2 - low[on, 1]) * slope[on]
        order = np.argsort(mid, kind="stable")
        on, mid = on[order], mid[order].tolist()
        at_lo = np.where(low[on, 1] == lo, low[on, 0], low[on, 0] + (lo - low[on, 1]) * slope[on])
        at_hi = np.where(high[on, 1] == hi, high[on, 0], low[on, 0] + (hi - low[on, 1]) * slope[on])
        # Rounded ordinates may stand a grain beside a crossing; edges keep their order at the strip's ends.
        at_lo, at_hi = (np.maximum.accumulate(np.round(x, digits)).tolist() for x in (at_lo, at_hi))
        within: set[int] = set()
        depth = [0, 0]
        opened: int | None = None
        spans: list[tuple[int, int]] = []
        for k, (o, s) in enumerate(zip(owner[on].tolist(), side[on].tolist(), strict=True)):
            depth[s] += -1 if o in within else 1
            within ^= {o}
            now = keep(depth[0] > 0, depth[1] > 0)
            if now and opened is None:
                opened = spans.pop()[0] if spans and mid[k] - mid[spans[-1][1]] <= grain else k
            elif not now and opened is not None:
                if mid[k] - mid[opened] > grain:
                    spans.append((opened, k))
                opened = None
        out += _levels(before, [(at_lo[a], at_lo[b]) for a, b in spans], lo)
        for a, b in spans:
            out.append(((at_hi[a], hi), (at_lo[a], lo), int(on[a])))
            out.append(((at_lo[b], lo), (at_hi[b], hi), int(on[b])))
        before = [(at_hi[a], at_hi[b]) for a, b in spans]
    return out + _levels(before, [], float(ys[-1]))


def _loops(border: list[tuple[Point, Point, int]]) -> Iterator[list[tuple[Point, int]]]:
    """Simple loops of ``(vertex, edge that leaves it)``; where several meet, a walk keeps to its own face."""
    leaving: dict[Point, list[int]] = defaultdict(list)
    for k, (a, _, _) in enumerate(border):
        leaving[a].append(k)

    def turn(a: Point, b: Point, k: int) -> float:
        back, c = math.atan2(a[1] - b[1], a[0] - b[0]), border[k][1]
        return (back - math.atan2(c[1] - b[1], c[0] - b[0])) % (2 * math.pi) or 2 * math.pi

    for first in list(leaving):
        while leaving[first]:
            path: list[tuple[Point, int]] = []
            place: dict[Point, int] = {}
            k = leaving[first].pop()
            while True:
                a, b, edge = border[k]
                place[a] = len(path)
                path.append((a, edge))
                if b in place:
                    cut = place[b]
                    yield path[cut:]
                    for v, _ in path[cut:]:
                        del place[v]
                    del path[cut:]
                if not leaving[b]:
                    break
                k = min(leaving[b], key=lambda j: turn(a, b, j))
                leaving[b].remove(k)


def _straight(a: Point, b: Point, c: Point) -> bool:
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]
    return ux * vy == uy * vx and ux * vx + uy * vy >= 0


def _corners(loop: list[tuple[Point, int]]) -> list[Point]:
    """The loop without points inside one edge or on a straight line, from its least corner on."""
    kept = [v for k, (v, edge) in enumerate(loop) if loop[k - 1][1] != edge]
    kept = [v for k, v in enumerate(kept) if not _straight(kept[k - 1], v, kept[(k + 1) % len(kept)])]
    at = kept.index(min(kept)) if kept else 0
    return kept[at:] + kept[:at]


def signed_area(ring) -> float:
    """Above zero for a ring that runs against the clock."""
    r = np.asarray(ring, float)
    r = r - r[0]
    n = np.roll(r, -1, axis=0)
    return float((r[:, 0] * n[:, 1] - n[:, 0] * r[:, 1]).sum() / 2)


def combine(region: list[Rings], other: list[Rings] | None = None, keep: Callable[[bool, bool], bool] = union, digits: int = DIGITS) -> list[list[list[Point]]]:
    """Where ``keep(in any of region, in any of other)``, as polygons: an outer ring, then its holes.

    Outer rings run against the clock, holes with it; rings are simple, don't
    repeat their first point and meet others in points at most.  Inputs fill by
    the even-odd rule.  Pieces thinner than the last decimal are left out.
    """
    sides = [(k, [np.round(np.asarray(ring, float), digits) for ring in r]) for k, rs in enumerate((region, other or [])) for r in rs]
    sides = [(k, r) for k, r in sides if len(_edges(r)[0])]
    if not sides:
        return []
    outers, holes = [], []
    for loop in _loops(_border(sides, keep, digits)):
        ring = _corners(loop)
        if len(ring) < 3:
            continue
        area = signed_area(ring)
        around = sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        if abs(area) > 10.0**-digits * around:
            (outers if area > 0 else holes).append((abs(area), ring))
    outers.sort()
    own: list[list[list[Point]]] = [[] for _ in outers]
    if holes:
        # A hole's corner can touch its outer ring, the middle of a side can't.
        middle = np.array([((h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2) for _, h in holes])
        open_ = np.ones(len(holes), bool)
        for k, (area, ring) in enumerate(outers):
            fits = open_ & np.array([a < area for a, _ in holes])
            if fits.any():
                fits[fits] = inside(middle[fits], [np.array(ring)])
                own[k] = [holes[i][1] for i in np.flatnonzero(fits)]
                open_ &= ~fits
    return sorted([ring, *sorted(own[k])] for k, (_, ring) in enumerate(outers))


def is_simple(rings: Rings, parts: list[list[list[Point]]], digits: int = DIGITS) -> bool:
    """Whether a polygon is one part with just its own rings and corners, so that ``combine`` mended nothing."""
    own = []
    for r in rings:
        points = [tuple(v) for v in np.round(np.asarray(r, float), digits).tolist()]
        points = [v for k, v in enumerate(points) if v != points[k - 1]]
        own.append(sorted(v for k, v in enumerate(points) if not _straight(points[k - 1], v, points[(k + 1) % len(points)])))
    return len(parts) == 1 and sorted(own) == sorted(sorted(r) for r in parts[0])


# -- on Spark ----------------------------------------------------------------------------


def rings_area(rings: Column) -> Column:
    """Of a polygon as :func:`combine` gives it, holes taken off."""

    def ring(r: Column) -> Column:
        n, o = F.size(r), F.element_at(r, 1)
        dx, dy = lambda p: p["x"] - o["x"], lambda p: p["y"] - o["y"]
        pair = lambda i: (F.element_at(r, i), F.element_at(r, i % n + 1))
        twice = lambda p, q: dx(p) * dy(q) - dx(q) * dy(p)
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + twice(*pair(i))) / 2

    return F.aggregate(rings, F.lit(0.0), lambda a, r: a + ring(r))


def _plain(parts: list[list[list[Point]]]) -> list[list[list[dict]]]:
    return [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]


def repair(polygons: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``(*columns, part, rings, repaired)``: each polygon as valid ones, a row for each part.

    Self-crossing rings are split at the crossing, rings that touch in points
    part there, holes belong to the part around them.  The area is that of the
    even-odd rule: what rings cover twice is open.  A polygon without area has
    no row; null rings count as none.  ``repaired`` tells whether anything but
    the order of corners changed.
    """
    keep = [c for c in polygons.columns if c != "rings"]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    kind = polygons.select(row).schema["row"].dataType.simpleString()

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for own, polygon in zip(pdf["row"], pdf["rings"], strict=True):
                rings = _rings(polygon) if polygon is not None else []
                parts = combine([rings], digits=digits)
                mended = not is_simple([r for r in rings if len(r)], parts, digits)
                rows += [(own, k, part, mended) for k, part in enumerate(_plain(parts))]
            yield frame(rows, ["row", "part", "rings", "repaired"])

    out = polygons.select(row, shipped(F.col("rings")).alias("rings")).mapInPandas(mend, f"row {kind}, part int, rings {POLYGON}, repaired boolean")
    return out.select("row.*", "part", "rings", "repaired")


def _clipped(ring: np.ndarray, w: float, s: float, e: float, n: float) -> np.ndarray:
    """The ring in a rectangle.  Where it leaves and comes back it runs along a side; what it runs there twice has no area under the even-odd rule."""
    for axis, bound, sign in ((0, w, 1), (0, e, -1), (1, s, 1), (1, n, -1)):
        d = (ring[:, axis] - bound) * sign
        ok = d >= 0
        if ok.all():
            continue
        after, d_after = np.roll(ring, -1, axis=0), np.roll(d, -1)
        crosses = ok != np.roll(ok, -1)
        at = ring + (d / np.where(crosses, d - d_after, 1))[:, None] * (after - ring)
        at[:, axis] = bound
        ring = np.stack([ring, at], axis=1).reshape(-1, 2)[np.stack([ok, crosses], axis=1).ravel()]
    return ring


def _cut(polygons: DataFrame, keys: list[str], size: float) -> DataFrame:
    """``(*keys, cx, cy, rings)``: each different polygon in the squares that its box meets, cut to the square."""
    kinds = dict(polygons.dtypes)
    placed = polygons.select(*keys, "rings").distinct().select(*keys, "rings", F.inline(cells_of(rings_box(F.col("rings")), size))).withColumn("rings", shipped(F.col("rings")))
    names = [*keys, "cx", "cy", "rings"]

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *own, cx, cy, polygon in pdf[names].itertuples(index=False, name=None):
                rings = [_clipped(r, cx * size, cy * size, (cx + 1) * size, (cy + 1) * size) for r in _rings(polygon) if len(r) >= 3]
                rings = [r.tolist() for r in rings if len(r) >= 3 and np.ptp(r, axis=0).all()]
                if rings:
                    rows.append((*own, cx, cy, *_plain([rings])))
            yield frame(rows, names)

    return placed.mapInPandas(clip, "".join(f"{k} {kinds[k]}, " for k in keys) + f"cx long, cy long, rings {POLYGON}")


def _merged(parts: DataFrame, where: list[str], salts: int, batch: int, digits: int) -> DataFrame:
    """The union of what one square and salt holds, a batch at a time."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, limit = None, [], batch
        for pdf in batches:
            rows = []
            for *own, polygon in pdf[[*where, "rings"]].itertuples(index=False, name=None):
                if own != now:
                    rows += [(*now, part) for part in _plain(combine(held, digits=digits))] if held else []
                    now, held, limit = own, [], batch
                held.append(_rings(polygon))
                if len(held) >= limit:
                    held = combine(held, digits=digits)
                    limit = max(batch, 2 * len(held))
            yield frame(rows, [*where, "rings"])
        if held:
            yield frame([(*now, part) for part in _plain(combine(held, digits=digits))], [*where, "rings"])

    salt = F.pmod(F.xxhash64("rings"), F.lit(salts)).alias("salt")
    dealt = parts.select(*where, "rings", salt).repartition(*where, "salt").sortWithinPartitions(*where, "salt")
    return dealt.select(*where, shipped(F.col("rings")).alias("rings")).mapInPandas(merge, parts.schema)


def dissolve(polygons: DataFrame, keys: list[str], size: float = FRAGMENT_M, batch: int = BATCH, digits: int = DIGITS) -> DataFrame:
    """``(*keys, cx, cy, rings)``: the union of the polygons of each key, cut to squares, one row for each connected part in a square.

    A layer's union can be as large as its city, so it has no row of its own;
    the parts meet at the squares' sides and nowhere else, and their areas add
    up.  Copies of a polygon are removed before anything moves.  A square of
    many polygons is dealt out by their hashes and united in a tree, so a task
    holds a batch of them and the union so far.  The order of rows does not
    matter.  Null and empty polygons add nothing; a null key is a key.
    """
    scratch = Scratch(polygons.sparkSession, "dissolve")
    where = [*keys, "cx", "cy"]
    parts = scratch.write(_cut(polygons.filter("size(flatten(rings)) > 0"), keys, size))
    most = parts.groupBy(*where).count().agg(F.max("count")).first()[0] or 0
    while most > batch:
        most = -(-most // batch)
        after = scratch.write(_merged(parts, where, most, batch, digits))
        scratch.drop(parts)
        parts = after
    return _merged(parts, where, 1, batch, digits)


def overlay(region: DataFrame, other: DataFrame, keys: list[str], keep: Callable[[bool, bool], bool] = difference, size: float = FRAGMENT_M, batch: int = BATCH, digits: int = DIGITS) -> DataFrame:
    """``(*keys, cx, cy, rings)``: what ``keep`` leaves of the unions of two layers, cut to squares as by :func:`dissolve`.

    ``keep`` is :func:`common` or :func:`difference`.  Both layers are united
    first, so a square's rows are the parts of two unions, however many
    polygons lie on each other there.
    """
    scratch = Scratch(region.sparkSession, "overlay")
    where = [*keys, "cx", "cy"]
    gather = lambda layer, name: scratch.write(dissolve(layer, keys, size, batch, digits)).groupBy(*where).agg(F.collect_list(F.struct(shipped(F.col("rings")).alias("rings"))).alias(name))
    a, b = gather(region, "a"), gather(other, "b")
    same = F.lit(True)
    for k in where:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.alias("a").join(b.alias("b"), same, "left").select(*[f"a.{k}" for k in where], "a", "b")
    kinds = dict(a.dtypes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *own, a, b in pdf[[*where, "a", "b"]].itertuples(index=False, name=None):
                found = combine([_rings(r["rings"]) for r in a], [_rings(r["rings"]) for r in b] if b is not None else [], keep, digits)
                rows += [(*own, part) for part in _plain(found)]
            yield frame(rows, [*where, "rings"])

    return both.mapInPandas(work, "".join(f"{k} {kinds[k]}, " for k in where) + f"rings {POLYGON}")


def ground_shade(selected: DataFrame, sun: DataFrame, size: float = FRAGMENT_M) -> DataFrame:
    """``(scenario, cx, cy, rings)``: ground in shadow and outside all footprints, in each scenario."""
    scenarios = F.broadcast(sun.select("scenario").distinct())  # the scenarios are a fixed few
    return overlay(shadow_polygons(selected, sun), footprints(selected).crossJoin(scenarios), ["scenario"], difference, size, digits=6)
