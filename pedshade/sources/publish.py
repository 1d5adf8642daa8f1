"""Sinks: all-or-nothing publishing, versions, shards, vector tiles and reports."""

from __future__ import annotations

import json
import math
import os
import shutil
import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedshade.functions.geo import tiles_of
from pedshade.sources.files import write_files


def publish_files(files: dict[str, bytes], rename: Callable[[str, str], None] = os.replace) -> None:
    """Writes small driver-side documents together or not at all.

    Every file is written beside its place first; if a rename fails, what was
    there before comes back, and what was not there is removed.
    """
    token = uuid.uuid4().hex
    staged, saved, done = {}, {}, []
    try:
        for path, content in files.items():
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            staged[path] = f"{path}.{token}.tmp"
            with open(staged[path], "wb") as f:
                f.write(content)
        for path in files:
            if os.path.exists(path):
                saved[path] = f"{path}.{token}.old"
                shutil.copy2(path, saved[path])
        for path in files:
            rename(staged[path], path)
            done.append(path)
    except BaseException:
        for path in done:
            if path in saved:
                os.replace(saved.pop(path), path)
            else:
                os.remove(path)
        raise
    finally:
        for leftover in [*staged.values(), *saved.values()]:
            if os.path.exists(leftover):
                os.remove(leftover)


def _fs(df: DataFrame, path: str):
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def publish_tables(tables: dict[str, DataFrame], check: Callable[[str, DataFrame], None] | None = None) -> None:
    """Replaces several Parquet tables together: all are staged and checked before the first takes its place."""
    token = uuid.uuid4().hex
    staged: list[tuple[str, str]] = []
    moved: list[tuple[str, str | None]] = []
    any_df = next(iter(tables.values()))
    fs, Path = _fs(any_df, next(iter(tables)))
    try:
        for path, df in tables.items():
            tmp = f"{path}.{token}.tmp"
            staged.append((path, tmp))
            df.write.parquet(tmp)
            if check is not None:
                check(path, df.sparkSession.read.parquet(tmp))
        for path, tmp in staged:
            old = f"{path}.{token}.old" if fs.exists(Path(path)) else None
            if old:
                fs.rename(Path(path), Path(old))
            moved.append((path, old))
            if not fs.rename(Path(tmp), Path(path)):
                raise OSError(f"could not move {tmp} into place")
    except BaseException:
        for path, old in reversed(moved):
            fs.delete(Path(path), True)
            if old:
                fs.rename(Path(old), Path(path))
        raise
    finally:
        for _, tmp in staged:
            fs.delete(Path(tmp), True)
    for _, old in moved:
        if old:
            fs.delete(Path(old), True)


def write_version(df: DataFrame, base: str, stamp: str) -> str:
    """A new version of a table; earlier ones stay, ``latest_version`` finds the newest."""
    path = f"{base}/version={stamp}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_version(df_reader, base: str) -> DataFrame:
    """The newest version written below ``base``; the stamps' text order decides."""
    table = df_reader.option("basePath", base).parquet(base)
    newest = table.agg(F.max(F.col("version").cast("string")).alias("v")).first()["v"]
    return table.filter(F.col("version").cast("string") == newest).drop("version")


def write_shards(df: DataFrame, path: str, unit: str = "mesh_id") -> None:
    """Replaces the partitions of the units in ``df`` only; writing a unit again changes nothing else.

    Rows of a unit meet in one task first, or in a few if they are many, so
    that there is not a file for each unit and task.
    """
    df.hint("rebalance", unit).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(unit).parquet(path)


# -- vector tiles -------------------------------------------------------------------------

EXTENT, TILE_BUFFER, ZOOMS = 4096, 32, (10, 11, 12, 13)
#: Points that lie this near to the line without them, in tile units, are left out.
TOLERANCE = 3.0


def _varint(n: int) -> bytes:
    if n < 128:
        return bytes((n,))
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _zigzag(n: int) -> int:
    return n << 1 ^ n >> 63


def clip_to_tile(line: list[tuple[float, float]], low: float, high: float) -> list[list[tuple[float, float]]]:
    """Parts of a polyline within the square [low, high]^2."""
    parts: list[list[tuple[float, float]]] = []
    for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
        t0, t1, dx, dy = 0.0, 1.0, x1 - x0, y1 - y0
        inside = low <= x0 <= high and low <= x1 <= high and low <= y0 <= high and low <= y1 <= high
        for p, q in () if inside else ((-dx, x0 - low), (dx, high - x0), (-dy, y0 - low), (dy, high - y0)):
            if p == 0:
                if q < 0:
                    t0, t1 = 1.0, 0.0
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if t0 > t1:
            continue
        a, b = (x0 + t0 * dx, y0 + t0 * dy), (x0 + t1 * dx, y0 + t1 * dy)
        if parts and parts[-1][-1] == a:
            parts[-1].append(b)
        else:
            parts.append([a, b])
    return parts


def simplified(line: list[tuple[float, float]], tolerance: float = TOLERANCE) -> list[tuple[float, float]]:
    """A line with the fewest of its points kept by halving at the farthest one; ends stay."""
    if tolerance <= 0 or len(line) < 3:
        return line
    keep, spans = {0, len(line) - 1}, [(0, len(line) - 1)]
    while spans:
        a, b = spans.pop()
        (x0, y0), (x1, y1) = line[a], line[b]
        dx, dy = x1 - x0, y1 - y0
        far, worst = 0, tolerance * tolerance
        for k in range(a + 1, b):
            px, py = line[k][0] - x0, line[k][1] - y0
            t = min(1.0, max(0.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            off = (px - t * dx) ** 2 + (py - t * dy) ** 2
            if off > worst:
                far, worst = k, off
        if far:
            keep.add(far)
            spans += [(a, far), (far, b)]
    return [line[k] for k in sorted(keep)]


def encode_line(line: list[tuple[float, float]], tolerance: float = TOLERANCE) -> bytes:
    """A line's geometry within a tile, simplified, clipped and rounded; empty where nothing of it is left."""
    geometry: list[int] = []
    at = (0, 0)
    for part in clip_to_tile(simplified(line, tolerance), -TILE_BUFFER, EXTENT + TILE_BUFFER):
        points = [(round(x), round(y)) for x, y in part]
        points = [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]
        if len(points) < 2:
            continue
        geometry += [1 << 3 | 1, _zigzag(points[0][0] - at[0]), _zigzag(points[0][1] - at[1]), len(points) - 1 << 3 | 2]
        for a, b in zip(points, points[1:], strict=False):
            geometry += [_zigzag(b[0] - a[0]), _zigzag(b[1] - a[1])]
        at = points[-1]
    return b"".join(map(_varint, geometry))


def assemble_tile(features: list[tuple[bytes, dict]], layer: str = "default") -> bytes:
    """A vector tile (version 2) of encoded lines and their properties; empty bytes without any."""
    keys: dict[str, int] = {}
    values: dict[object, int] = {}
    out = []
    for geometry, properties in features:
        if not geometry:
            continue
        tags: list[int] = []
        for k, v in properties.items():
            if v is not None:
                tags += [keys.setdefault(k, len(keys)), values.setdefault(v, len(values))]
        out.append(_block(2, _block(2, b"".join(map(_varint, tags))) + _varint(3 << 3) + _varint(2) + _block(4, geometry)))
    if not out:
        return b""
    body = _block(1, layer.encode()) + b"".join(out) + b"".join(_block(3, k.encode()) for k in keys)
    body += b"".join(_block(4, _block(1, v.encode()) if isinstance(v, str) else _varint(3 << 3 | 1) + struct.pack("<d", v)) for v in values)
    return _block(3, body + _varint(5 << 3) + _varint(EXTENT) + _varint(15 << 3) + _varint(2))


def encode_tile(features: list[tuple[list[tuple[float, float]], dict]], layer: str = "default", tolerance: float = TOLERANCE) -> bytes:
    """A vector tile of polylines in tile units; empty bytes without any."""
    return assemble_tile([(encode_line(line, tolerance), p) for line, p in features], layer)


def vector_tiles(features: DataFrame, properties: list[str], zooms: tuple[int, ...] = ZOOMS, layer: str = "default", tolerance: float = TOLERANCE) -> DataFrame:
    """``(z, x, y, n_features, tile)``: features with ``geometry`` (structs lon, lat) in the tiles that their boxes meet.

    A line reaches Python once, with the list of its tiles, and is projected
    once for all of them; only the bytes that a tile holds anyway meet in its
    group.  Tiles without any part of a line are left out.
    """
    axis = lambda f, n: f(F.transform("geometry", lambda p: p[n]))
    box = (axis(F.array_min, "lon"), axis(F.array_min, "lat"), axis(F.array_max, "lon"), axis(F.array_max, "lat"))

    def at(zoom: int):
        return F.transform(tiles_of(*box, zoom), lambda t: F.struct(F.lit(zoom).alias("z"), t["x"].alias("x"), t["y"].alias("y")))

    tiles = F.flatten(F.array(*map(at, zooms)))
    # Plain arrays, which Arrow hands over as such.
    each = lambda c, n: F.transform(c, lambda p: p[n])
    rows = features.select(*properties, *[each("geometry", n).alias(f"_{n}") for n in ("lon", "lat")], tiles.alias("_tiles"))
    rows = rows.select(*properties, "_lon", "_lat", *[each("_tiles", n).alias(f"_{n}") for n in "zxy"])
    kinds = dict(features.dtypes)
    own = "".join(f"{c} {kinds[c]}, " for c in properties)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lines become a tile's few bytes before tiles are grouped; what vanishes in a tile goes."""
        for pdf in parts:
            out = []
            values = zip(*(pdf[c].tolist() for c in properties), strict=True) if properties else [()] * len(pdf)
            for r, *parts_of in zip(values, *(pdf[f"_{c}"] for c in ("lon", "lat", "z", "x", "y")), strict=True):
                lons, lats, *tiles_at = (a.tolist() for a in parts_of)
                whole = []
                for lon, lat in zip(lons, map(math.radians, lats), strict=True):
                    whole.append(((lon + 180) / 360, (1 - math.log(math.tan(lat) + 1 / math.cos(lat)) / math.pi) / 2))
                for z, x, y in zip(*tiles_at, strict=True):
                    n = 2.0**z
                    line = [((px * n - x) * EXTENT, (py * n - y) * EXTENT) for px, py in whole]
                    if encoded := encode_line(line, tolerance):
                        out.append((*r, z, x, y, encoded))
            yield pd.DataFrame(out, columns=[*properties, "z", "x", "y", "line"])

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values([*properties, "line"], kind="stable").to_dict("records")
        tile = assemble_tile([(r["line"], {k: r[k] for k in properties if r[k] == r[k]}) for r in rows], layer)
        return pd.DataFrame({"z": [int(pdf.z.iloc[0])], "x": [int(pdf.x.iloc[0])], "y": [int(pdf.y.iloc[0])], "n_features": [len(rows)], "tile": [tile]})

    lines = rows.mapInPandas(cut, own + "z int, x long, y long, line binary")
    return lines.groupBy("z", "x", "y").applyInPandas(encode, "z int, x long, y long, n_features long, tile binary")


def write_tiles(tiles: DataFrame, directory: str) -> None:
    """One file ``z/x/y.pbf`` a tile and nothing else; none before all are written."""
    write_files(tiles.select(F.concat_ws("/", "z", "x", F.concat("y", F.lit(".pbf"))).alias("path"), F.col("tile").alias("content")), directory, marker=False)


def write_layers(layers: dict[str, tuple[DataFrame, list[str]]], directory: str, bounds: tuple[float, float, float, float], zooms: tuple[int, ...] = ZOOMS) -> None:
    """Vector tiles of several layers, ``layer/z/x/y.pbf``, and a TileJSON ``layer.json`` each, all in one commit.

    ``layers`` has the features of each layer and the names of their properties.
    """
    out = None
    for name, (features, properties) in layers.items():
        tiles = vector_tiles(features, properties, zooms, name)
        files = tiles.select(F.concat_ws("/", F.lit(name), "z", "x", F.concat("y", F.lit(".pbf"))).alias("path"), F.col("tile").alias("content"))
        described = features.sparkSession.createDataFrame([(f"{name}.json", bytearray(tile_json(name, bounds, zooms)))], "path string, content binary")
        files = files.unionByName(described)
        out = files if out is None else out.unionByName(files)
    if out is not None:
        write_files(out, directory)


def decode_tile(raw: bytes) -> list[tuple[str, list[list[tuple[int, int]]], dict]]:
    """``(layer, lines, properties)`` of each feature of a vector tile of lines."""
    out = []
    for number, layer in _fields(raw):
        if number != 3:
            continue
        name, features, keys, values = "", [], [], []
        for n, v in _fields(layer):
            if n == 1:
                name = v.decode()
            elif n == 2:
                features.append(dict(_fields(v)))
            elif n == 3:
                keys.append(v.decode())
            elif n == 4:
                kind, value = next(iter(_fields(v)))
                values.append(value.decode() if kind == 1 else value)
        for f in features:
            tags = _varints(f.get(2, b""))
            out.append((name, _lines(_varints(f.get(4, b""))), {keys[k]: values[v] for k, v in zip(tags[0::2], tags[1::2], strict=True)}))
    return out


def _varints(raw: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in raw:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(value)
            value, shift = 0, 0
    return out


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a message's fields: bytes, whole numbers, or doubles."""
    at = 0

    def varint() -> int:
        nonlocal at
        end = at
        while raw[end] > 127:
            end += 1
        value = _varints(raw[at : end + 1])[0]
        at = end + 1
        return value

    while at < len(raw):
        key = varint()
        if key & 7 == 2:
            size = varint()
            yield key >> 3, raw[at : at + size]
            at += size
        elif key & 7 == 1:
            yield key >> 3, struct.unpack_from("<d", raw, at)[0]
            at += 8
        else:
            yield key >> 3, varint()


def _lines(commands: list[int]) -> list[list[tuple[int, int]]]:
    lines: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        kind, count = commands[at] & 7, commands[at] >> 3
        at += 1
        for _ in range(count):
            dx, dy = ((v >> 1) ^ -(v & 1) for v in commands[at : at + 2])
            x, y, at = x + dx, y + dy, at + 2
            if kind == 1:
                lines.append([])
            lines[-1].append((x, y))
    return lines


def tile_json(name: str, bounds: tuple[float, float, float, float], zooms: tuple[int, ...] = ZOOMS) -> bytes:
    document = {"tilejson": "3.0.0", "name": name, "scheme": "xyz", "tiles": [f"{name}/{{z}}/{{x}}/{{y}}.pbf"], "minzoom": min(zooms), "maxzoom": max(zooms), "bounds": list(bounds)}
    return (json.dumps(document, indent=2) + "\n").encode()


def markdown_report(title: str, tables: dict[str, DataFrame], digits: int = 4, most: int = 200) -> str:
    """Summary tables as Markdown; for results of a few rows, larger ones are an error."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} is too long for a report")
        show = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(show(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)


def report_lines(title: str, tables: dict[str, tuple[DataFrame, list[str]]], digits: int = 4, most: int = 200) -> DataFrame:
    """``(line_no, line)``: the report of :func:`markdown_report` as a table; tables come with the columns they go by.

    A table of more than ``most`` rows is an error once the report is read.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    fixed, lines = [(0, 0, f"# {title}"), (0, 1, "")], []
    for part, (name, (df, order)) in enumerate(tables.items(), 1):
        fixed += [(part, k, line) for k, line in enumerate((f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)))]
        fixed.append((part, most + 10, ""))
        number = lambda c, kind: F.format_string(f"%.{digits}f", c) if kind in ("double", "float") else c.cast("string")
        cells = [F.coalesce(number(F.col(c), kind), F.lit("–")) for c, kind in df.dtypes]
        rows = df.limit(most + 1).select(F.row_number().over(Window.orderBy(*order)).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
        checked = F.when(F.col("n") > most, F.raise_error(F.lit(f"{name} is too long for a report")).cast("string")).otherwise(F.col("line"))
        lines.append(rows.select(F.lit(part).alias("part"), (F.col("n") + 3).alias("nth"), checked.alias("line")))
    out = spark.createDataFrame(fixed, "part int, nth int, line string")
    for rows in lines:
        out = out.unionByName(rows)
    return out.select((F.row_number().over(Window.orderBy("part", "nth")) - 1).cast("long").alias("line_no"), "line")
