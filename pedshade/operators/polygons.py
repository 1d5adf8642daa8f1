"""Planar kernels in numpy: a polygon is a list of rings, filled by the even-odd rule.

Even-odd filling makes rings of either direction, holes and self-touching
rings well defined, so no repair step precedes these kernels.
"""

from __future__ import annotations

import math

import numpy as np

Rings = list[np.ndarray]


def _edges(rings: Rings) -> tuple[np.ndarray, np.ndarray]:
    """Start and end points of all ring edges; rings close themselves."""
    a = [np.asarray(r, float) for r in rings if len(r) >= 3]
    if not a:
        return np.zeros((0, 2)), np.zeros((0, 2))
    return np.concatenate(a), np.concatenate([np.roll(r, -1, axis=0) for r in a])


def inside(points: np.ndarray, rings: Rings) -> np.ndarray:
    """Whether each point lies within, by counting crossings to its right."""
    p, q = _edges(rings)
    if not len(p):
        return np.zeros(len(points), bool)
    x, y = points[:, 0, None], points[:, 1, None]
    spans = (p[None, :, 1] > y) != (q[None, :, 1] > y)
    dy = np.where(q[:, 1] == p[:, 1], 1.0, q[:, 1] - p[:, 1])
    at = p[None, :, 0] + (y - p[None, :, 1]) * ((q[:, 0] - p[:, 0]) / dy)[None, :]
    return ((spans & (at > x)).sum(axis=1) % 2).astype(bool)


def line_intervals(line: np.ndarray, rings: Rings, epsilon: float = 1e-9) -> list[tuple[float, float]]:
    """Stretches of a polyline, in distance from its start, that lie within a polygon.

    Parametric in the line, so closed and self-crossing lines keep their own
    distances.  A stretch along the polygon's border is decided at its middle.
    """
    line = np.asarray(line, float)
    p, q = _edges(rings)
    out: list[tuple[float, float]] = []
    at = 0.0
    for a, b in zip(line[:-1], line[1:], strict=True):
        d = b - a
        length = float(np.hypot(*d))
        if length <= epsilon:
            at += length
            continue
        e, w = q - p, p - a
        cross = d[0] * e[:, 1] - d[1] * e[:, 0]
        safe = np.where(np.abs(cross) < 1e-15, 1.0, cross)
        t = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / safe
        u = (w[:, 0] * d[1] - w[:, 1] * d[0]) / safe
        hit = (np.abs(cross) >= 1e-15) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
        ends = (w @ d) / (length * length), ((q - a) @ d) / (length * length)
        flat = np.abs(cross) < 1e-15  # parallel edges cut at their own ends
        cuts = np.unique(np.concatenate([[0.0, 1.0], t[hit], *(x[flat & (x > 0) & (x < 1)] for x in ends)]))
        mid = (cuts[:-1] + cuts[1:]) / 2
        within = inside(a + mid[:, None] * d, rings)
        for lo, hi, ok in zip(cuts[:-1], cuts[1:], within, strict=True):
            if ok:
                s, f = at + lo * length, at + hi * length
                if out and s - out[-1][1] <= epsilon:
                    out[-1] = (out[-1][0], f)
                else:
                    out.append((s, f))
        at += length
    return [(s, f) for s, f in out if f - s > epsilon]


def _heights(polygons: list[Rings]) -> np.ndarray:
    """Ordinates of all vertices and of all crossings between edges."""
    parts = [_edges(r) for r in polygons]
    p, q = (np.concatenate(x) for x in zip(*parts, strict=True))
    ys = [p[:, 1]]
    for i in range(len(p) - 1):
        d, e, w = q[i] - p[i], q[i + 1 :] - p[i + 1 :], p[i + 1 :] - p[i]
        cross = d[0] * e[:, 1] - d[1] * e[:, 0]
        ok = np.abs(cross) > 1e-18
        t = np.where(ok, (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / np.where(ok, cross, 1), -1)
        u = np.where(ok, (w[:, 0] * d[1] - w[:, 1] * d[0]) / np.where(ok, cross, 1), -1)
        hit = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        ys.append(p[i, 1] + t[hit] * d[1])
    return np.unique(np.concatenate(ys))


def _across(rings: Rings, y: float) -> list[tuple[float, float]]:
    p, q = _edges(rings)
    spans = (p[:, 1] > y) != (q[:, 1] > y)
    p, q = p[spans], q[spans]
    x = np.sort(p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1]))
    return list(zip(x[0::2].tolist(), x[1::2].tolist(), strict=True))


def _union(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _common(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    total, i, j = 0.0, 0, 0
    while i < len(a) and j < len(b):
        total += max(0.0, min(a[i][1], b[j][1]) - max(a[i][0], b[j][0]))
        if a[i][1] <= b[j][1]:
            i += 1
        else:
            j += 1
    return total


def union_areas(region: list[Rings], cover: list[Rings] | None = None) -> tuple[float, float]:
    """Area of the union of ``region``, and of its part under the union of ``cover``.

    Between neighbouring ordinates no two edges cross, so a strip's area is its
    height times the width at its middle; overlaps count once.
    """
    every = [r for r in [*region, *(cover or [])] if len(_edges(r)[0])]
    if not every:
        return 0.0, 0.0
    ys = _heights(every)
    area = covered = 0.0
    for lo, hi in zip(ys[:-1], ys[1:], strict=True):
        mid, h = (lo + hi) / 2, hi - lo
        a = _union([s for r in region for s in _across(r, mid)])
        area += h * sum(e - s for s, e in a)
        if cover:
            covered += h * _common(a, _union([s for r in cover for s in _across(r, mid)]))
    return area, covered


def buffer(line: np.ndarray, distance: float, quarter: int = 8) -> list[Rings]:
    """Capsules around each segment; their union is the line's round buffer.

    Arcs have ``quarter`` segments to a right angle.
    """
    line = np.asarray(line, float)
    out: list[Rings] = []
    for a, b in zip(line[:-1], line[1:], strict=True):
        angle = math.atan2(b[1] - a[1], b[0] - a[0])
        turn = angle - math.pi / 2 + np.arange(2 * quarter + 1) * (math.pi / (2 * quarter))
        right = b + distance * np.stack([np.cos(turn), np.sin(turn)], axis=1)
        left = a + distance * np.stack([np.cos(turn + math.pi), np.sin(turn + math.pi)], axis=1)
        out.append([np.concatenate([right, left])])
    return out


def polygonize(ways: "DataFrame") -> "DataFrame":
    """``(area_id, rings, n_open)``: ways joined at their ends to closed rings, one row for each area.

    ``ways`` has area_id, way_id and line, an array of structs (x, y).  A way
    may run either way round; each is used once, ways that close alone are
    rings.  What stays open is counted and left out.  Holes need no marking:
    rings fill by the even-odd rule.  An area's ways are one group: a boundary,
    never a layer.
    """
    import pandas as pd

    def close(pdf: "pd.DataFrame") -> "pd.DataFrame":
        lines = [[(p["x"], p["y"]) for p in w] for w in pdf.sort_values("way_id").line]
        at: dict[tuple, list[int]] = {}
        for k, line in enumerate(lines):
            for end in (line[0], line[-1]):
                at.setdefault(end, []).append(k)
        used, rings, n_open = set(), [], 0
        for k, line in enumerate(lines):
            if k in used or len(line) < 2:
                continue
            used.add(k)
            chain, mine = list(line), 1
            while chain[0] != chain[-1]:
                follow = next((j for j in at[chain[-1]] if j not in used), None)
                if follow is None:
                    break
                used.add(follow)
                mine += 1
                more = lines[follow] if lines[follow][0] == chain[-1] else lines[follow][::-1]
                chain += more[1:]
            if chain[0] == chain[-1] and len(chain) > 3:
                rings.append([{"x": x, "y": y} for x, y in chain])
            else:
                n_open += mine
        return pd.DataFrame({"area_id": [pdf.area_id.iloc[0]], "rings": [rings], "n_open": [n_open]})

    return ways.groupBy("area_id").applyInPandas(close, "area_id long, rings array<array<struct<x: double, y: double>>>, n_open long")
