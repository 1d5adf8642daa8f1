"""Archives, manifests and raw files: listings, digests, single entries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedshade.sources.files import STEP, Ranges, listed
from pedshade.sources.publish import latest_version, write_version

#: Fixed values of the ZIP format: signatures and the 64-bit marker.
_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL, _BIG = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50, 0xFFFFFFFF
BUILDING_PATH = r"(?:^|/)udx/bldg/[^/]+_bldg_6697(?:_2)?_op\.gml$"


@dataclass(frozen=True)
class Entry:
    path: str
    method: int
    crc: int
    packed: int
    size: int
    offset: int


class RangeZip:
    """Reads single entries of a ZIP file, 64-bit ones included, through ``read_range(start, length)``."""

    def __init__(self, size: int, read_range: Callable[[int, int], bytes]):
        self.size, self.read = size, read_range
        self._entries: dict[str, Entry] | None = None

    def entries(self) -> dict[str, Entry]:
        if self._entries is None:
            start, length, count = self._directory()
            found = list(self._parse(self.read(start, length)))
            if len(found) != count:
                raise ValueError(f"the archive's directory has {len(found)} entries and not {count}")
            self._entries = {e.path: e for e in found}
        return self._entries

    def _directory(self) -> tuple[int, int, int]:
        """Start and length of the central directory, and how many entries it must hold."""
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(struct.pack("<I", _END))
        if at < 0:
            raise ValueError("the archive has no end record")
        disk, first_disk, here, count, length, start = struct.unpack_from("<HHHHII", tail, at + 4)
        if (disk, first_disk) not in ((0, 0), (0xFFFF, 0xFFFF)) or here != count:
            raise ValueError("archives over several disks are not supported")
        if _BIG in (length, start) or count == 0xFFFF:
            where = tail.rfind(struct.pack("<I", _LOCATOR64), 0, at)
            if where < 0:
                raise ValueError("the archive's 64-bit locator is missing")
            record, disks = struct.unpack_from("<QI", tail, where + 8)
            head = self.read(record, 56) if record + 56 <= self.size else b""
            if len(head) < 56 or struct.unpack_from("<I", head)[0] != _END64:
                raise ValueError("the archive's 64-bit end record is broken")
            disk, first_disk, here, count, length, start = struct.unpack_from("<IIQQQQ", head, 16)
            if disks > 1 or disk or first_disk or here != count:
                raise ValueError("archives over several disks are not supported")
        if start + length > self.size:
            raise ValueError("the archive's directory lies beyond its end")
        return start, length, count

    @staticmethod
    def _parse(raw: bytes) -> Iterator[Entry]:
        at = 0
        while at + 46 <= len(raw) and struct.unpack_from("<I", raw, at)[0] == _CENTRAL:
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            crc, packed, size, n, m, k = struct.unpack_from("<IIIHHH", raw, at + 16)
            (offset,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = raw[at + 46 + n : at + 46 + n + m], 0
            while e + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # 64-bit values, only those that did not fit above, in this order
                    wide = list(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                    size = wide.pop(0) if size == _BIG else size
                    packed = wide.pop(0) if packed == _BIG else packed
                    offset = wide.pop(0) if offset == _BIG else offset
                e += 4 + length
            yield Entry(name, method, crc, packed, size, offset)
            at += 46 + n + m + k

    def read_entry(self, path: str) -> bytes:
        return b"".join(inflate(self.entries()[path], self.read))


def inflate(e: Entry, read_range: Callable[[int, int], bytes], step: int = STEP) -> Iterator[bytes]:
    """An entry's bytes in pieces, read and unpacked a step at a time; a wrong length or checksum is an error at the end."""
    head = read_range(e.offset, 30)
    if len(head) < 30 or struct.unpack_from("<I", head)[0] != _LOCAL:
        raise ValueError(f"{e.path}: the local header is broken")
    n, m = struct.unpack_from("<HH", head, 26)
    if e.method not in (0, 8):
        raise ValueError(f"{e.path}: compression method {e.method} is not supported")
    start = e.offset + 30 + n + m
    unpack = zlib.decompressobj(-15) if e.method == 8 else None
    size = crc = 0
    for at in range(start, start + e.packed, step):
        raw = read_range(at, min(step, start + e.packed - at))
        while raw or (unpack and unpack.unconsumed_tail):
            if unpack:
                data = unpack.decompress(raw, step)  # a step of packed bytes can hold a thousand times as many
                raw = unpack.unconsumed_tail
            else:
                data, raw = raw, b""
            size, crc = size + len(data), zlib.crc32(data, crc)
            if data:
                yield data
            elif not raw:
                break
    data = unpack.flush() if unpack else b""
    size, crc = size + len(data), zlib.crc32(data, crc)
    if data:
        yield data
    if size != e.size or crc != e.crc:
        raise ValueError(f"{e.path}: length or checksum does not match")


def safe_name(path: str) -> bool:
    """False for names that would leave the folder they are unpacked to."""
    parts = path.replace("\\", "/").split("/")
    return not (path.startswith(("/", "\\")) or ".." in parts or (len(path) > 1 and path[1] == ":"))


_ENTRIES = "archive string, path string, method int, crc long, packed long, size long, offset long"


def _directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            with Ranges(archive) as file:
                rows = [(archive, e.path, e.method, e.crc, e.packed, e.size, e.offset) for e in RangeZip(file.size, file.read).entries().values()]
            for _, path, *_ in rows:
                if not safe_name(path):
                    raise ValueError(f"unsafe entry name {path!r}")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _ENTRIES.split(", ")])


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, path, method, crc, packed, size, offset)`` of the entries of the archives at or below ``path``.

    A row an archive goes to the tasks, which read the archives' ends and
    directories alone.  An unsafe name is an error.
    """
    files = listed(spark, path, ".zip").select("path")
    return files.repartition(max(1, files.count()), "path").mapInArrow(_directories, _ENTRIES)  # a number, as so few bytes would be merged into one task


#: Packed bytes that a task reads, about; a larger entry is a task of its own.
TASK_BYTES = 64 << 20


def entry_rows(entries: DataFrame, kernel: Callable[[Entry, Ranges], Iterator[pa.RecordBatch]], schema: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """What ``kernel`` yields for each row of :func:`zip_entries`, given the entry and its archive opened."""
    columns = [c.split()[0] for c in _ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name = None, None
        try:
            for batch in batches:
                for archive, path, method, crc, packed, size, offset in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                    if archive != name:
                        if file:
                            file.file.close()
                        file, name = Ranges(archive), archive
                    yield from kernel(Entry(path, method, crc, packed, size, offset), file)
        finally:
            if file:
                file.file.close()

    total = entries.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]
    n = max(entries.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    # Entries of an archive that stand together are read together.
    spread = entries.select(*columns).repartition(n, "archive", F.expr(f"offset div {task_bytes}"))
    return spread.sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def read_pieces(entries: DataFrame, piece_bytes: int = 8 << 20, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``(archive, path, nth, content)``: the unpacked entries in pieces, never a whole entry in memory."""

    def pieces(e: Entry, file: Ranges) -> Iterator[pa.RecordBatch]:
        held, size, nth = [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file.path]), pa.array([e.path]), pa.array([nth], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["archive", "path", "nth", "content"])

        for data in inflate(e, file.read):
            held.append(data)
            size += len(data)
            if size >= piece_bytes:
                yield row()
                held, size, nth = [], 0, nth + 1
        if held or not nth:
            yield row()

    return entry_rows(entries, pieces, "archive string, path string, nth int, content binary", task_bytes)


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, path, size, crc)`` of the entries of all archives; an unsafe name is an error."""
    return zip_entries(spark, path).select("archive", "path", "size", "crc")


def entries_of(files: DataFrame) -> DataFrame:
    """The entries of the archives in a column ``content``, named by ``path``."""
    def entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                raw = bytes(content)
                rows = [(name, e.path, e.size, e.crc) for e in RangeZip(len(raw), lambda s, n: raw[s : s + n]).entries().values()]
                for _, p, *_ in rows:
                    if not safe_name(p):
                        raise ValueError(f"unsafe entry name {p!r}")
                yield pd.DataFrame(rows, columns=["archive", "path", "size", "crc"])

    return files.select("path", "content").mapInPandas(entries, "archive string, path string, size long, crc long")


def read_entries(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(archive, path, content)`` of the entries whose names match; only their ranges are read."""
    wanted = zip_entries(spark, path).filter(~F.col("path").endswith("/") & F.col("path").rlike(pattern))
    return read_pieces(wanted, 2**31 - 1).select("archive", "path", "content")


def contents_of(files: DataFrame, pattern: str = "") -> DataFrame:
    """The unpacked entries, of names that match, of the archives in a column ``content``; an unsafe name is an error."""
    def contents(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for pdf in parts:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                raw = bytes(content)
                z = RangeZip(len(raw), lambda s, n, raw=raw: raw[s : s + n])
                for p in sorted(z.entries()):
                    if not safe_name(p):
                        raise ValueError(f"unsafe entry name {p!r}")
                    if not p.endswith("/") and re.search(pattern, p):
                        yield pd.DataFrame({"archive": [name], "path": [p], "content": [z.read_entry(p)]})

    return files.select("path", "content").mapInPandas(contents, "archive string, path string, content binary")


def stage(name: str, base: str, fetch: Callable[[], DataFrame], stamp: str, force: bool = False) -> str:
    """Stages a source below ``base`` and returns ``cached`` or ``staged``.

    What is staged already serves again without a fetch unless ``force`` is
    set.  A new version is written beside the earlier ones, which stay, and a
    fetch that fails leaves the last one as it was.
    """
    spark = SparkSession.active()
    path = f"{base}/{name}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not force and any(fs.exists(s.getPath().suffix("/_SUCCESS")) for s in (fs.listStatus(p) if fs.exists(p) else [])):
        return "cached"
    write_version(fetch(), path, stamp)
    return "staged"


def staged(spark: SparkSession, name: str, base: str) -> DataFrame:
    """The newest version of a staged source."""
    return latest_version(spark.read, f"{base}/{name}")


def is_building_path(path: Column) -> Column:
    return path.rlike(BUILDING_PATH)


def discover_buildings(entries: DataFrame) -> DataFrame:
    """Building files with their mesh code, in (mesh, path) order."""
    mesh = F.regexp_extract("path", r"([0-9]{8})[^/]*$", 1)
    return entries.filter(is_building_path(F.col("path"))).withColumn("mesh_id", mesh).orderBy("mesh_id", "path")


def file_manifest(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``(path, size, modified, sha256)`` of the files below a folder, hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    keep = ~F.regexp_extract("path", r"([^/]*)$", 1).startswith(".")
    for k, s in enumerate(suffixes):
        one = F.lower("path").endswith(s.lower())
        any_ = one if k == 0 else any_ | one
    if suffixes:
        keep = keep & any_
    return files.filter(keep).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def raw_status(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> str:
    """``available`` or ``missing``: absent folders are a status, not an error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return "missing"
    return "missing" if file_manifest(spark, path, suffixes).isEmpty() else "available"


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON shards of a folder, documents or lines, with the unit that each file, or its folder ``unit_id=..``, is named after."""
    name = F.input_file_name()
    folder = F.nullif(F.regexp_extract(name, r"/unit_id=([^/]+)/", 1), F.lit(""))
    return spark.read.schema(schema).json(path).withColumn("unit_id", F.coalesce(folder, F.regexp_extract(name, r"([^/]+)\.json$", 1)))


#: The kinds of sources a deployment stages, and what each must hold.
SOURCES = (
    ("roads", "GraphML or graph JSON", ".json .graphml"),
    ("greenery", "polygons as Parquet rings", ".parquet"),
    ("stations", "CSV or GeoJSON points", ".csv .geojson"),
    ("buildings", "CityGML, plain or zipped", ".gml .zip"),
    ("boundaries", "area configuration", ".json"),
    ("tiles", "vector tiles", ".pbf"),
)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, d, s.split()) for n, d, s in SOURCES], "source string, description string, suffixes array<string>")


def read_area(spark: SparkSession, path: str) -> dict:
    """A strict area configuration: id, name, centre inside a box that is not reversed, zoom."""
    schema = "id string, name string, center array<double>, zoom double, boundingBox array<double>"
    row = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).first()
    if row is None or any(v is None for v in row) or len(row.center) != 2 or len(row.boundingBox) != 4:
        raise ValueError("the area needs id, name, centre, zoom and a box of four")
    west, south, east, north = row.boundingBox
    if not (west < east and south < north):
        raise ValueError("the bounding box is reversed")
    if not (west <= row.center[0] <= east and south <= row.center[1] <= north):
        raise ValueError("the centre lies outside the box")
    return {"id": row.id, "name": row.name, "center": tuple(row.center), "zoom": row.zoom, "bbox": (west, south, east, north)}


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of a GraphML cache: x and y of nodes, length of edges, ids as ``source:target:key``."""
    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import xml.etree.ElementTree as ET

        for pdf in parts:
            for raw in pdf.content:
                keys, rows = {}, []
                for _, e in ET.iterparse(io.BytesIO(bytes(raw))):
                    name = e.tag.rsplit("}", 1)[-1]
                    if name == "key":
                        keys[e.get("id")] = e.get("attr.name")
                    elif name in ("node", "edge"):
                        data = {keys.get(d.get("key"), d.get("key")): d.text for d in e if d.tag.endswith("data")}
                        rows.append((name, e.get("id"), e.get("source"), e.get("target"), data))
                        e.clear()
                yield pd.DataFrame(rows, columns=["kind", "id", "source", "target", "data"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "kind string, id string, source string, target string, data map<string, string>")
    nodes = rows.filter("kind = 'node'").select(F.col("id").alias("node_id"), F.col("data")["x"].cast("double").alias("lon"), F.col("data")["y"].cast("double").alias("lat"))
    edges = rows.filter("kind = 'edge'").select(
        F.concat_ws(":", "source", "target", F.coalesce("id", F.lit("0"))).alias("edge_id"), "source", "target", F.col("data")["length"].cast("double").alias("length")
    )
    return nodes, edges
