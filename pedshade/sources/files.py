"""Files that tasks read by ranges and write with a commit, in any store that Arrow reaches (local, HDFS, viewfs, S3, GCS)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STEP = 1 << 20


def store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and the path within it; a path without a scheme is local."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(.*)$", path)
    if m is None or m[1] == "file":
        return arrow_fs.LocalFileSystem(), m[3] if m else path
    # Only the root goes through a URI, as names may hold characters that URIs escape.
    found, root = arrow_fs.FileSystem.from_uri(f"{m[1]}://{m[2] or ''}/")
    return found, root.rstrip("/") + m[3]


class Ranges:
    """A file read by ranges; ``bytes_read`` counts what was asked for."""

    def __init__(self, path: str):
        self.path = path
        where, name = store(path)
        self.file = where.open_input_file(name)
        self.size: int = self.file.size()
        self.bytes_read = 0

    def read(self, start: int, length: int) -> bytes:
        self.bytes_read += length
        return self.file.read_at(length, start)

    def steps(self, start: int, end: int, step: int = STEP) -> Iterator[bytes]:
        for at in range(start, end, step):
            yield self.read(at, min(step, end - at))

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def listed(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``(path, size)`` of the files at or below ``path``, without opening them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(F.col("path").endswith(suffix)).select("path", F.col("length").alias("size"))


@dataclass
class Written(WriterCommitMessage):
    """Files that one task put below the staging folder."""

    folder: str
    names: list[str] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    """Tasks write to folders of their own; the commit moves the files of the tasks that count."""

    def __init__(self, base: str, marker: bool):
        self.base, self.marker = base, marker
        self.staging = f"{base}/_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done = Written(f"{self.staging}/{uuid.uuid4().hex}")
        where, folder = store(done.folder)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"a file's name must stay below the folder: {name!r}")
                if "/" in name or not done.names:
                    where.create_dir(f"{folder}/{name}".rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(content or b"")
                done.names.append(name)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        where, base = store(self.base)
        made: set[str] = set()
        seen: set[str] = set()
        for m in messages:
            again = seen & set(m.names) if m else set()
            if again:
                self.abort(messages)
                raise ValueError(f"two rows name {min(again)!r}")
            seen |= set(m.names) if m else set()
        for m in messages:
            for name in m.names if m else ():
                parent = f"{base}/{name}".rsplit("/", 1)[0]
                if parent not in made:
                    where.create_dir(parent, recursive=True)
                    made.add(parent)
                where.move(f"{store(m.folder)[1]}/{name}", f"{base}/{name}")
        self._clear()
        if not self.marker:
            return
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, staging = store(self.staging)
        if where.get_file_info(staging).type != arrow_fs.FileType.NotFound:
            where.delete_dir(staging)


class FileSink(DataSource):
    """``df.write.format("files")``: a file for each row (path, content), below the folder of the option ``path``.

    No file appears before every task is done: a task that fails leaves
    nothing, and of several attempts at one task only the last counts.  Files
    of the same names are replaced, others stay; ``_SUCCESS`` comes last, so
    what a crash within the commit leaves is told by its absence.  The option
    ``marker`` set to false leaves it out.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if {"path", "content"} - set(schema.names):
            raise ValueError("files need the columns path and content")
        return _Writer(self.options["path"].rstrip("/"), self.options.get("marker", "true") == "true")


def write_files(files: DataFrame, base: str, marker: bool = True) -> None:
    """Writes a file for each row (path, content); see :class:`FileSink`."""
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).write.format("files").option("marker", str(marker).lower()).mode("append").save(base)
