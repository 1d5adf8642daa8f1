"""Buildings of CityGML files, one at a time, as nested rows.

A file is read in splits of bytes.  A split has the members that start in it;
its task reads the file's head, which holds the namespaces and the reference
system, and then the split in steps, so that neither a file nor a split is
ever whole in memory.  Members inside of comments are not told from others.
"""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pedshade.operators.cover import BUILDING
from pedshade.sources.archives import entry_rows, inflate
from pedshade.sources.files import STEP, Ranges, store

#: Attribute names of the formats.
GML_ID, HREF = "{http://www.opengis.net/gml}id", "{http://www.w3.org/1999/xlink}href"
#: Bytes of a split, and buildings of a batch.
SPLIT_BYTES, BATCH_BUILDINGS = 64 << 20, 200
_MEMBER = re.compile(rb"<(?:[\w.-]+:)?cityObjectMember(?=[\s>/])")
_CRS = re.compile(rb"""\bsrsName\s*=\s*["']([^"']*)["']""")
#: Bytes that two steps of a search share, so that no tag between them is missed.
_SHARED = 256


class CityGmlError(ValueError):
    pass


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(e: ET.Element, *names: str) -> list[ET.Element]:
    return [x for x in e.iter() if _name(x) in names]


def _ring(boundary: ET.Element) -> list[dict]:
    """A ring's points; files give latitude, longitude, height, which swap here."""
    rings = _all(boundary, "LinearRing")
    if not rings:
        raise CityGmlError("a polygon boundary has no ring")
    texts = [x for x in rings[0] if _name(x) in ("posList", "pos")]
    if not texts:
        raise CityGmlError("a ring has no positions")
    values: list[float] = []
    for t in texts:
        for holder in (t, rings[0]):
            if holder.get("srsDimension", "3") != "3":
                raise CityGmlError("coordinates must have three dimensions")
        try:
            values += map(float, (t.text or "").split())
        except ValueError as error:
            raise CityGmlError("a coordinate is no number") from error
    if len(values) % 3 or not all(map(math.isfinite, values)):
        raise CityGmlError("coordinates must be complete and finite")
    return [{"x": lon, "y": lat, "z": z} for lat, lon, z in zip(values[0::3], values[1::3], values[2::3], strict=True)]


def _surface(polygon: ET.Element, kind: str | None) -> dict:
    outer = [c for c in polygon if _name(c) == "exterior"]
    if not outer:
        raise CityGmlError("a polygon has no exterior")
    rings = [_ring(outer[0]), *(_ring(c) for c in polygon if _name(c) == "interior")]
    return {"id": polygon.get(GML_ID), "kind": kind, "rings": rings}


def _known(owner: ET.Element) -> dict[str, dict]:
    """Surfaces by id, with the kind of the boundary around them; the first of an id stays."""
    found: dict[str, dict] = {}
    for holder in _all(owner, "boundedBy"):
        for boundary in holder:
            for p in _all(boundary, "Polygon"):
                if p.get(GML_ID):
                    found.setdefault(p.get(GML_ID), _surface(p, _name(boundary)))
    for p in _all(owner, "Polygon"):
        if p.get(GML_ID):
            found.setdefault(p.get(GML_ID), _surface(p, None))
    return found


def _solid(owner: ET.Element, lod: int, known: dict[str, dict]) -> dict:
    surfaces, missing, seen = [], [], set()
    for holder in (c for c in owner if _name(c) == f"lod{lod}Solid"):
        for member in _all(holder, "surfaceMember"):
            href = member.get(HREF)
            if href:
                s = known.get(href[1:]) if href.startswith("#") else None
                if s is None:
                    missing.append(href.removeprefix("#"))
                elif s["id"] not in seen:
                    seen.add(s["id"])
                    surfaces.append(s)
                continue
            for p in _all(member, "Polygon"):
                s = known.get(p.get(GML_ID)) if p.get(GML_ID) else _surface(p, None)
                if s["id"] is None or s["id"] not in seen:
                    seen.add(s["id"])
                    surfaces.append(s)
    return {"lod": lod, "surfaces": surfaces, "unresolved": list(dict.fromkeys(missing))}


def building(e: ET.Element, crs: str | None = None) -> dict:
    """One building; a building without parts is a single part of its own id."""
    key = e.get(GML_ID)
    if not key:
        raise CityGmlError("a building has no id")
    known = _known(e)
    heights = [c for c in e if _name(c) == "measuredHeight"]
    try:
        height = float(heights[0].text) if heights and heights[0].text else None
    except ValueError as error:
        raise CityGmlError("measuredHeight is no number") from error
    owners = _all(e, "BuildingPart") or [e]
    named = next((x.get("srsName") for x in e.iter() if x.get("srsName")), crs)
    parts = [{"part_id": o.get(GML_ID) or key, "lod1": _solid(o, 1, known), "lod2": _solid(o, 2, known)} for o in owners]
    return {"building_id": key, "measured_height": height, "crs": named, "parts": parts}


def iter_buildings(raw: bytes) -> Iterator[dict]:
    """Buildings in file order; see :func:`buildings_of`."""
    return buildings_of(raw[at : at + STEP] for at in range(0, len(raw), STEP))


def buildings_of(pieces: Iterable[bytes], crs: str | None = None, whole: bool = True) -> Iterator[dict]:
    """Buildings of a document that comes in pieces; each subtree is released once read.

    The document's first srsName is inherited.  Where it is not ``whole`` it
    may end before its last tags.
    """
    parser = ET.XMLPullParser(("start", "end"))
    stack: list[ET.Element] = []

    def read() -> Iterator[dict]:
        nonlocal crs
        for event, e in parser.read_events():
            if event == "start":
                stack.append(e)
                continue
            stack.pop()
            if crs is None and e.get("srsName"):
                crs = e.get("srsName")
            if _name(e) == "Building":
                yield building(e, crs)
                e.clear()
            elif _name(e) == "cityObjectMember":
                e.clear()
                if stack:
                    stack[-1].remove(e)

    for piece in pieces:
        parser.feed(piece)
        yield from read()
    if whole:
        parser.close()
        yield from read()


def _search(file: Ranges, pattern: re.Pattern, start: int, end: int) -> tuple[int, bytes] | None:
    """The place of the pattern's first match that starts in [start, end), and its first group."""
    for at in range(start, end, STEP):
        m = pattern.search(file.read(at, min(STEP + _SHARED, file.size - at)))
        if m and at + m.start() < end:
            return at + m.start(), m[1] if pattern.groups else b""
    return None


def split_buildings(file: Ranges, start: int, end: int) -> Iterator[dict]:
    """Buildings of the members that start in [start, end)."""
    first = None if file.read(0, 2) in (b"\xfe\xff", b"\xff\xfe") else _search(file, _MEMBER, 0, file.size)
    if first is None:  # a document without members, or in characters of two bytes, is one split
        if start == 0:
            yield from buildings_of(file.steps(0, file.size))
        return
    begin = _search(file, _MEMBER, max(start, first[0]), end)
    if begin is None:
        return
    last = _search(file, _MEMBER, end, file.size)
    named = _search(file, _CRS, 0, begin[0])

    def pieces() -> Iterator[bytes]:
        yield from file.steps(0, first[0])
        yield from file.steps(begin[0], last[0] if last else file.size)

    yield from buildings_of(pieces(), named[1].decode("utf-8", "replace") if named else None, last is None)


def _batches(buildings: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for b in buildings:
        held.append(b)
        if len(held) == BATCH_BUILDINGS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, split_bytes: int):
        self.schema, self.path, self.split_bytes = to_arrow_schema(schema), path, split_bytes

    def partitions(self) -> list[Split]:
        where, name = store(self.path)
        info = where.get_file_info(name)
        found = [info] if info.type == arrow_fs.FileType.File else where.get_file_info(arrow_fs.FileSelector(name, recursive=True))
        root = self.path[: len(self.path.rstrip("/")) - len(name.rstrip("/"))] if self.path.rstrip("/").endswith(name.rstrip("/")) else ""
        shown = sorted((f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Split(root + path, at, min(at + self.split_bytes, size)) for path, size in shown for at in range(0, size, self.split_bytes)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        with Ranges(split.path) as file:
            yield from _batches(split_buildings(file, split.start, split.end), self.schema)


class CityGmlSource(DataSource):
    """``spark.read.format("citygml").load(path)``: buildings of the file, or of all files below the folder.

    Option ``splitBytes`` is the size of a split; each split is a task.
    """

    @classmethod
    def name(cls) -> str:
        return "citygml"

    def schema(self) -> str:
        return BUILDING

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_buildings(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Building rows of the files at or below ``path``; see :class:`CityGmlSource`."""
    spark.dataSource.register(CityGmlSource)
    return spark.read.format("citygml").option("splitBytes", split_bytes).load(path)


def zipped_buildings(entries: DataFrame) -> DataFrame:
    """Building rows of CityGML files in archives, from rows of :func:`archives.zip_entries`; unpacked and read in steps."""
    schema = to_arrow_schema(entries.sparkSession.createDataFrame([], BUILDING).schema)
    return entry_rows(entries, lambda e, file: _batches(buildings_of(inflate(e, file.read)), schema), BUILDING)


def parse_buildings(files: DataFrame) -> DataFrame:
    """Building rows of documents in a column ``content``, for such as a row can hold."""
    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for raw in pdf.content:
                batch = []
                for b in iter_buildings(bytes(raw)):
                    batch.append(b)
                    if len(batch) == 200:
                        yield pd.DataFrame(batch)
                        batch = []
                if batch:
                    yield pd.DataFrame(batch)

    return files.select("content").mapInPandas(parse, BUILDING)
