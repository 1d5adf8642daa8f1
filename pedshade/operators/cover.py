"""Greenery along edges, and shadows on them: box joins refined by planar kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedshade.functions.solar import project_vertex
from pedshade.operators import intervals
from pedshade.operators.polygons import buffer, line_intervals, union_areas
from pedshade.operators.ranks import quantiles
from pedshade.operators.spatial import box_pairs, line_box

GREEN_BUFFER_M, FRAGMENT_M = 15.0, 100.0

#: A polygon column: rings of structs (x, y).
POLYGON = "array<array<struct<x: double, y: double>>>"


def _ring(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


def shipped(rings: Column) -> Column:
    """A polygon on its way to a Python worker: pandas refuses arrays of arrays that differ in length, so rings go as structs."""
    return F.transform(rings, lambda r: F.struct(r.alias("ring")))


def _rings(polygon) -> list[np.ndarray]:
    """Of a shipped polygon."""
    return [_ring(r["ring"]) for r in polygon]


#: Rows that a Python worker holds as objects at once; nested ones take many times their size in Arrow.
ROWS_AT_ONCE = 256


def _slices(batches: Iterator[pa.RecordBatch], at_once: int = ROWS_AT_ONCE) -> Iterator[list[dict]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, at_once):
            yield batch.slice(lo, at_once).to_pylist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rings_box(rings: Column) -> Column:
    return line_box(F.flatten(rings))


def fragments(polygons: DataFrame, size: float = FRAGMENT_M) -> DataFrame:
    """``(poly_id, cx, cy, west, south, east, north, area)`` of each polygon in the grid squares it meets.

    Large polygons spread over many squares, so no one task holds them whole
    against everything near them; squares with no area of it are left out.
    """
    from pedshade.operators.spatial import cells_of

    schema = pa.schema([("poly_id", pa.int64()), ("cx", pa.int64()), ("cy", pa.int64()), ("area", pa.float64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _slices(batches):
            rows = []
            for r in held:
                w, s = r["cx"] * size, r["cy"] * size
                square = [np.array([(w, s), (w + size, s), (w + size, s + size), (w, s + size)])]
                _, area = union_areas([square], [_rings(r["rings"])])
                if area > 0:
                    rows.append((r["poly_id"], r["cx"], r["cy"], area))
            yield _batch(rows, schema)

    placed = polygons.select("poly_id", "rings", F.inline(cells_of(rings_box(F.col("rings")), size))).withColumn("rings", shipped(F.col("rings")))
    # Squares take long for their few bytes, so a fixed number of tasks shares them: a small file is one split, and adaptive execution goes by bytes.
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "poly_id", "cx", "cy").mapInArrow(cut, "poly_id long, cx long, cy long, area double")


def green_scores(lines: DataFrame, polygons: DataFrame, distance: float = GREEN_BUFFER_M, cell: float = FRAGMENT_M) -> DataFrame:
    """``(edge_id, green_score)``: share of an edge's buffer under the union of the polygons near it.

    ``lines`` has edge_id and line, an array of structs (x, y) in metres;
    ``polygons`` poly_id and rings.  Edges with no polygon near have 0.
    """
    b = line_box(F.col("line"))
    wide = F.struct(*[(b[k] + F.lit(s * distance)).alias(k) for k, s in (("west", -1), ("south", -1), ("east", 1), ("north", 1))])
    left = lines.select("edge_id", "line", wide.alias("box"))
    # A polygon that comes twice adds nothing to a union.
    right = polygons.select("rings").distinct().select(F.struct(shipped(F.col("rings")).alias("rings")).alias("polygon"), rings_box(F.col("rings")).alias("box"))
    near = box_pairs(left, right, cell).groupBy("l.edge_id").agg(F.first("l.line").alias("line"), F.collect_list("r.polygon").alias("polygons"))

    schema = pa.schema([("edge_id", pa.string()), ("green_score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _slices(batches):
            rows = []
            for r in held:
                area, green = union_areas(buffer(_ring(r["line"]), distance), [_rings(p["rings"]) for p in r["polygons"]])
                rows.append((r["edge_id"], min(1.0, max(0.0, green / area)) if area > 0 else 0.0))
            yield _batch(rows, schema)

    got = near.mapInArrow(score, "edge_id string, green_score double")
    return lines.select("edge_id").join(got, "edge_id", "left").select("edge_id", F.coalesce("green_score", F.lit(0.0)).alias("green_score"))


def line_polygon_intervals(lines: DataFrame, polygons: DataFrame, keys: list[str], cell: float = FRAGMENT_M) -> DataFrame:
    """``(edge_id, *keys, s, e)``: where each line lies within each polygon, in distance from its start."""
    left = lines.select("edge_id", "line", line_box(F.col("line")).alias("box"))
    right = polygons.select(*keys, shipped(F.col("rings")).alias("rings"), rings_box(F.col("rings")).alias("box"))
    pairs = box_pairs(left, right, cell).select("l.edge_id", "l.line", *[f"r.{k}" for k in keys], "r.rings")
    kinds = dict(polygons.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The keys keep the types that they came with.
            schema = pa.schema([(k, batch.schema.field(k).type) for k in ("edge_id", *keys)] + [("s", pa.float64()), ("e", pa.float64())])
            for held in _slices([batch]):
                rows = []
                for r in held:
                    own = tuple(r[k] for k in keys)
                    rows += [(r["edge_id"], *own, s, e) for s, e in line_intervals(_ring(r["line"]), _rings(r["rings"]))]
                yield _batch(rows, schema)

    return pairs.mapInArrow(cut, "edge_id string, " + "".join(f"{k} {kinds[k]}, " for k in keys) + "s double, e double")


# -- buildings ---------------------------------------------------------------------------

SURFACE = "struct<id: string, kind: string, rings: array<array<struct<x: double, y: double, z: double>>>>"
SOLID = f"struct<lod: int, surfaces: array<{SURFACE}>, unresolved: array<string>>"
BUILDING = f"building_id string, measured_height double, crs string, parts array<struct<part_id: string, lod1: {SOLID}, lod2: {SOLID}>>"


def _ring_valid(ring: Column) -> Column:
    finite = F.forall(ring, lambda p: ~(F.isnan(p["x"]) | F.isnan(p["y"]) | F.isnan(p["z"])))
    closed = F.element_at(ring, 1) == F.element_at(ring, -1)
    return (F.size(ring) >= 4) & F.coalesce(closed, F.lit(False)) & finite & (F.size(F.array_distinct(ring)) >= 3)


def _zs(solid: Column, kind: str | None = None) -> Column:
    surfaces = solid["surfaces"] if kind is None else F.filter(solid["surfaces"], lambda s: s["kind"] == kind)
    return F.transform(F.flatten(F.flatten(F.transform(surfaces, lambda s: s["rings"]))), lambda p: p["z"])


def solid_complete(solid: Column) -> Column:
    """No unresolved link, four surfaces or more, closed finite rings, and some height."""
    rings_ok = F.forall(solid["surfaces"], lambda s: F.forall(s["rings"], _ring_valid) & (F.size(s["rings"]) > 0))
    z = _zs(solid)
    return F.coalesce((F.size(solid["unresolved"]) == 0) & (F.size(solid["surfaces"]) >= 4) & rings_ok & (F.array_max(z) > F.array_min(z)), F.lit(False))


def select_solids(buildings: DataFrame) -> DataFrame:
    """Buildings with the solids of their best complete level of detail; a level holds for all parts or for none.

    ``lod`` is null, and ``flag`` ``incomplete``, where neither level is whole.
    Measured height is compared, never used.
    """
    whole = lambda k: F.forall("parts", lambda p: solid_complete(p[f"lod{k}"])) & (F.size("parts") > 0)
    lod = F.when(whole(2), 2).when(whole(1), 1)
    solids = F.when(lod == 2, F.transform("parts", lambda p: p["lod2"])).when(lod == 1, F.transform("parts", lambda p: p["lod1"]))
    picked = buildings.select("building_id", "measured_height", lod.alias("lod"), solids.alias("solids"))
    z = F.flatten(F.transform("solids", lambda s: _zs(s)))
    height = F.array_max(z) - F.array_min(z)
    m = F.col("measured_height")
    measured = F.when((m > 0) & ~F.isnan(m) & (m < float("inf")), m)
    ground = lambda s: F.coalesce(F.array_min(_zs(s, "GroundSurface")), F.array_min(_zs(s)))
    return picked.select(
        "building_id", "lod", F.transform("solids", lambda s: F.struct(s["surfaces"].alias("surfaces"), ground(s).alias("ground"))).alias("solids"),
        F.array_min(z).alias("min_z"), F.array_max(z).alias("max_z"), height.alias("height"), measured.alias("measured"), (height - measured).alias("height_difference"),
        F.when(F.col("lod").isNull(), "incomplete").when(F.col("lod") == 1, "lod1_fallback").otherwise("").alias("flag"),
    )


def _flat(surface: Column) -> Column:
    return F.transform(surface["rings"], lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))


def footprints(selected: DataFrame) -> DataFrame:
    """``(building_id, rings)``: ground surfaces, or without any the surfaces that lie at ground height."""
    solids = selected.filter("lod is not null").select("building_id", F.explode("solids").alias("s"))
    marked = F.filter("s.surfaces", lambda f: f["kind"] == "GroundSurface")
    level = F.filter("s.surfaces", lambda f: F.forall(f["rings"][0], lambda p: F.abs(p["z"] - F.col("s.ground")) <= 1e-6))
    chosen = F.when(F.size(marked) > 0, marked).otherwise(level)
    return solids.select("building_id", F.explode(chosen).alias("f")).select("building_id", _flat(F.col("f")).alias("rings"))


def shadow_polygons(selected: DataFrame, sun: DataFrame) -> DataFrame:
    """``(building_id, scenario, rings)``: every surface thrown onto its solid's ground.

    ``sun`` has scenario, azimuth and elevation, a row for each scenario.
    """
    faces = selected.filter("lod is not null").select("building_id", F.explode("solids").alias("s")).select("building_id", F.col("s.ground").alias("ground"), F.explode("s.surfaces").alias("f"))
    rows = faces.crossJoin(F.broadcast(sun.select("scenario", "azimuth", "elevation")))  # the scenarios are a fixed few
    thrown = F.transform("f.rings", lambda r: F.transform(r, lambda p: project_vertex(p["x"], p["y"], p["z"], F.col("ground"), F.col("azimuth"), F.col("elevation"))))
    return rows.select("building_id", "scenario", thrown.alias("rings"))


def shade_scores(lines: DataFrame, selected: DataFrame, sun: DataFrame, cell: float = FRAGMENT_M) -> DataFrame:
    """``(edge_id, scenario, score)``: share of an edge in shadow, outside all footprints.

    Shadows and footprints are cut to intervals of the edge and merged there,
    so no union of polygons is ever built.
    """
    lines = lines.select("edge_id", "line")
    # A shadow or footprint that comes twice covers nothing more.
    shadow = line_polygon_intervals(lines, shadow_polygons(selected, sun).select("scenario", "rings").distinct(), ["scenario"], cell)
    scenarios = F.broadcast(sun.select("scenario").distinct())
    foot = line_polygon_intervals(lines, footprints(selected).select("rings").distinct(), [], cell).crossJoin(scenarios)
    steps = F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.hypot(F.element_at("line", i + 1)["x"] - F.element_at("line", i)["x"], F.element_at("line", i + 1)["y"] - F.element_at("line", i)["y"]))
    lengths = lines.select("edge_id", F.aggregate(steps, F.lit(0.0), lambda a, x: a + x).alias("length")).crossJoin(scenarios)
    return intervals.covered_ratio(shadow, foot, lengths, ["edge_id", "scenario"]).withColumnRenamed("ratio", "score")


def building_report(selected: DataFrame) -> DataFrame:
    """Counts by level of detail, and the least, median and largest height: one row."""
    heights = quantiles(selected.select(F.lit(0).alias("k"), "height"), ["k"], "height", (0.5,))
    counts = selected.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lod") == 2).alias("n_lod2"), F.count_if(F.col("lod") == 1).alias("n_lod1"), F.count_if(F.col("lod").isNull()).alias("n_incomplete"),
        F.min("height").alias("min_height"), F.max("height").alias("max_height"),
    ).withColumn("k", F.lit(0))
    return counts.join(heights, "k", "left").select("n", "n_lod2", "n_lod1", "n_incomplete", "min_height", F.col("q")[0].alias("median_height"), "max_height")
