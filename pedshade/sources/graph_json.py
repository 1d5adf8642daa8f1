"""Graph, shade and station documents in JSON, and station lists in CSV."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedshade.config import SCENARIOS

_EDGE = "struct<id: string, source: string, target: string, length: double, geometry: array<array<double>>, green_score: double, water_penalty: double>"
GRAPH = f"metadata map<string, string>, nodes map<string, struct<lat: double, lon: double>>, edges array<{_EDGE}>"
SHADE = "metadata map<string, string>, edgeShadeScores map<string, array<double>>"
_PROPERTIES = "struct<name: string, address: string, location: string, admissionFeeNote: string, type: string, sourceId: string>"
STATIONS = f"type string, features array<struct<type: string, properties: {_PROPERTIES}, geometry: struct<type: string, coordinates: array<double>>>>"


class SourceError(ValueError):
    """A document that cannot be used; ``code`` names the stage for messages."""

    def __init__(self, message: str, code: str = "graph-load"):
        super().__init__(message)
        self.code = code


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of a graph document; geometry as structs (lon, lat)."""
    doc = spark.read.schema(GRAPH).option("multiLine", True).option("mode", "FAILFAST").json(path)
    nodes = doc.select(F.explode("nodes").alias("node_id", "p")).select("node_id", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))
    edges = doc.select(F.explode("edges").alias("e")).select(
        F.col("e.id").alias("edge_id"), "e.source", "e.target", "e.length",
        F.transform("e.geometry", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("geometry"), "e.green_score", "e.water_penalty",
    )
    return nodes, edges


#: Edges of the largest graph that is written as one document.
MOST_EDGES = 2_000_000


def _no_nan(edges: DataFrame) -> DataFrame:
    for c in ("length", "green_score", "water_penalty"):
        edges = edges.withColumn(c, F.when(F.isnan(c), F.raise_error(F.lit(f"{c} is NaN")).cast("double")).otherwise(F.col(c)))
    return edges


def graph_documents(nodes: DataFrame, edges: DataFrame, unit: str = "unit", version: str = "1.1.0") -> DataFrame:
    """``(unit, document)``: a JSON text for each unit of ``edges``, with the nodes at its edges' ends; NaN is an error.

    A unit is a tile or a ward, so that no row holds more than that.
    """
    ends = edges.select(unit, F.explode(F.array("source", "target")).alias("node_id")).distinct()
    place = F.struct(F.col("node_id").cast("string"), F.struct("lat", "lon"))
    n = ends.join(nodes.select("node_id", "lat", "lon"), "node_id").groupBy(unit).agg(F.map_from_entries(F.array_sort(F.collect_list(place))).alias("nodes"))
    geometry = F.transform("geometry", lambda p: F.array(p["lon"], p["lat"])).alias("geometry")
    row = F.struct(F.col("edge_id").cast("string").alias("id"), F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "length", geometry, "green_score", "water_penalty")
    e = _no_nan(edges).groupBy(unit).agg(F.array_sort(F.collect_list(row)).alias("edges"))
    meta = F.create_map(F.lit("graphVersion"), F.lit(version))
    return e.join(n, unit, "left").select(unit, F.to_json(F.struct(meta.alias("metadata"), "nodes", "edges")).alias("document"))


def graph_document(nodes: DataFrame, edges: DataFrame, version: str = "1.1.0", most_edges: int = MOST_EDGES) -> DataFrame:
    """One JSON text ``document`` for a graph that fits a browser, every node in it; beyond ``most_edges`` an error, as is NaN."""
    if edges.count() > most_edges:
        raise ValueError(f"one document holds {most_edges} edges at most; write graph_documents by tile")
    n = nodes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("node_id").cast("string"), F.struct("lat", "lon"))))).alias("nodes"))
    whole = graph_documents(nodes, edges.withColumn("unit", F.lit(0)), "unit", version)
    made = whole.select(F.from_json("document", f"edges array<{_EDGE}>").alias("d"))
    meta = F.create_map(F.lit("graphVersion"), F.lit(version))
    edges_of = F.coalesce(F.first("d.edges"), F.array().cast(f"array<{_EDGE}>")).alias("edges")
    return n.crossJoin(made.agg(edges_of)).select(F.to_json(F.struct(meta.alias("metadata"), "nodes", "edges")).alias("document"))  # one row each


def read_shade(spark: SparkSession, path: str) -> DataFrame:
    """``(edge_id, scenario, score)``; a score list of another length than the scenarios is an error."""
    doc = spark.read.schema(SHADE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = doc.select(F.explode("edgeShadeScores").alias("edge_id", "scores"))
    names = F.array(*[F.lit(s) for s in SCENARIOS])
    checked = F.when(F.size("scores") == len(SCENARIOS), F.col("scores")).otherwise(F.raise_error(F.lit("every edge needs a score for each scenario")).cast("array<double>"))
    return rows.select("edge_id", F.posexplode(checked).alias("i", "score")).select("edge_id", F.element_at(names, F.col("i") + 1).alias("scenario"), "score")


def shade_documents(shade: DataFrame, unit: str = "unit") -> DataFrame:
    """``(unit, document)``: a JSON text for each unit of a long shade table, scores at four decimals."""
    order = F.array(*[F.lit(s) for s in SCENARIOS])
    per = shade.groupBy(unit, "edge_id").agg(F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("scenario")).alias("i"), F.round("score", 4).alias("v")))).alias("s"))
    per = per.select(unit, "edge_id", F.transform("s", lambda x: x["v"]).alias("v"))
    return per.groupBy(unit).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge_id", "v")))).alias("edgeShadeScores")).select(unit, F.to_json(F.struct("edgeShadeScores")).alias("document"))


def shade_document(shade: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """One JSON text ``document`` of a shade table that fits a browser; beyond ``most_edges`` an error."""
    if shade.count() > most_edges * len(SCENARIOS):
        raise ValueError(f"one document holds {most_edges} edges at most; write shade_documents by tile")
    return shade_documents(shade.withColumn("unit", F.lit(0))).select("document")


def station_documents(stations: DataFrame, unit: str = "unit") -> DataFrame:
    """``(unit, document)``: a GeoJSON collection for each unit of a table with lon, lat and name, address, location or type."""
    names = [f.split(":")[0].strip() for f in _PROPERTIES[7:-1].split(",")]
    properties = F.struct(*[F.col(c).cast("string").alias(c) for c in names if c in stations.columns])
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"))
    return stations.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(F.to_json(feature).alias("text"), feature.alias("f")))).alias("fs")).select(
        unit, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda x: x["f"]).alias("features"))).alias("document")
    )


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations of a GeoJSON collection; anything but two-dimensional points in range is an error."""
    doc = spark.read.schema(STATIONS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    f = doc.select(F.explode("features").alias("f"))
    lon, lat = F.col("f.geometry.coordinates")[0], F.col("f.geometry.coordinates")[1]
    ok = (F.col("f.geometry.type") == "Point") & (F.size("f.geometry.coordinates") == 2) & lon.between(-180, 180) & lat.between(-90, 90)
    checked = F.when(F.coalesce(ok, F.lit(False)), lon).otherwise(F.raise_error(F.lit("stations must be points in range")).cast("double"))
    return f.select(checked.alias("lon"), lat.alias("lat"), "f.properties.*")


def csv_fields(files: DataFrame) -> DataFrame:
    """``(path, encoding, row, fields)`` of the rows of CSV files in UTF-8 or, where that fails, CP932.

    ``files`` has path and content.  Spark's reader has no CP932, so the bytes
    are decoded in Python.
    """
    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for pdf in parts:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    text, encoding = bytes(content).decode("utf-8-sig"), "utf-8"
                except UnicodeDecodeError:
                    text, encoding = bytes(content).decode("cp932"), "cp932"
                rows = csv.DictReader(io.StringIO(text))
                out = [(name, encoding, k, dict(r)) for k, r in enumerate(rows)]
                # A file without rows still tells its columns.
                yield pd.DataFrame(out or [(name, encoding, -1, dict.fromkeys(rows.fieldnames or []))], columns=["path", "encoding", "row", "fields"])

    return files.select("path", "content").mapInPandas(decode, "path string, encoding string, row long, fields map<string, string>")


def station_places(rows: DataFrame, lat: str = "緯度", lon: str = "経度") -> DataFrame:
    """CSV rows with a usable place, as numbers; others are left out."""
    x, y = (F.expr(f"try_cast(fields['{c}'] as double)") for c in (lon, lat))
    return rows.filter("row >= 0").select("row", x.alias("lon"), y.alias("lat"), "fields").filter(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))


def read_station_csv(spark: SparkSession, path: str, lat: str = "緯度", lon: str = "経度") -> DataFrame:
    """Stations of CSV files in CP932 or UTF-8; rows without a usable place are left out, an empty result is an error."""
    out = station_places(csv_fields(spark.read.format("binaryFile").load(path)), lat, lon)
    if out.isEmpty():
        raise SourceError("the station list is empty", "stations")
    return out


def inspect_csv(rows: DataFrame, required: tuple[str, ...], lat: str = "緯度", lon: str = "経度") -> DataFrame:
    """``(encoding, n_rows, n_placed, west, south, east, north, missing, nulls)``: one row for each encoding met.

    ``missing`` lists required columns that no file has, ``nulls`` counts each
    required column's empty values.
    """
    full = rows.filter("row >= 0").withColumns({"x": F.expr(f"try_cast(fields['{lon}'] as double)"), "y": F.expr(f"try_cast(fields['{lat}'] as double)")})
    ok = F.coalesce(F.col("x").between(-180, 180) & F.col("y").between(-90, 90), F.lit(False))
    empty = lambda c: F.coalesce(F.trim(F.col("fields")[c]) == "", F.lit(True))
    placed = lambda c: F.when(ok, F.col(c))
    seen = full.groupBy("encoding").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_placed"), F.min(placed("x")).alias("west"), F.min(placed("y")).alias("south"),
        F.max(placed("x")).alias("east"), F.max(placed("y")).alias("north"), F.array(*[F.count_if(empty(c)) for c in required]).alias("_n"),
    )
    has = rows.groupBy("encoding").agg(F.array(*[F.max(F.array_contains(F.map_keys("fields"), c)) for c in required]).alias("_has"))
    names = F.array(*map(F.lit, required))
    lacking = F.transform(F.filter(F.arrays_zip(names.alias("c"), F.col("_has").alias("h")), lambda z: ~z["h"]), lambda z: z["c"])
    return has.join(seen, "encoding", "left").select(
        "encoding", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_placed", F.lit(0)).alias("n_placed"), "west", "south", "east", "north",
        lacking.alias("missing"), F.map_from_arrays(names, "_n").alias("nulls"),
    )


def deterministic_payload(document: Column) -> Column:
    """A JSON document's text without the time it was made at, keys in order."""
    fields = F.map_entries(F.map_filter(F.from_json(document, "map<string, string>"), lambda k, _: k != "generatedAt"))
    return F.to_json(F.map_from_entries(F.array_sort(fields)))


def inspect_columns(df: DataFrame) -> DataFrame:
    """``(column, n_rows, n_null)`` of a table."""
    aggs = [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"), F.col(f"`{c}`").alias("n_null")) for c in df.columns])
    return wide.select(F.inline(pairs))
