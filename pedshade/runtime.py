"""Session and scratch-table helpers shared by every operator.

Iterative operators cut their lineage by writing a table to the folder that
all executors share.  That folder is the one the cluster names in
``spark.checkpoint.dir``; only a local master, as in tests, gets a folder of
its own when the setting is missing.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def ensure_importable(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started from.

    The folder that holds the package joins the workers' module path; machines
    that have a copy elsewhere keep their own path as well.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def local_session(cores: int | str = "*", app: str = "pedshade", partitions: int = 8) -> SparkSession:
    """A session for one machine: tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_importable(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables that every executor can read."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="pedshade-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return f"file://{_LOCAL[app]}"


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows for Spark, as plain objects: pandas' own string arrays can come in chunks, which Arrow structs refuse."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


def unbroadcast(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the graph, so it must never be broadcast.

    The planner takes a written table for as large as its files; places in
    order pack so well that millions of nodes stay under its limit.
    """
    return df.hint("merge")


class Scratch:
    """Tables of one operator call, written below :func:`shared_dir`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        if spark.sparkContext.master.startswith("local["):  # one machine: nothing outlives the process
            atexit.register(shutil.rmtree, self.base.removeprefix("file://"), True)

    def write(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns the written table, whose plan is one scan."""
        self._n += 1
        path = f"{self.base}/{self._n}"
        # zstd's writers free their buffers when they close; snappy's wait for the garbage collector.
        df.write.option("compression", "zstd").parquet(path)
        # The schema is known, so no job is needed to infer it.
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that :meth:`write` returned and nothing reads again."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def digest_of(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum of all columns: two numbers."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("h"),
    ).first()
    return int(row["n"]), int(row["h"])
