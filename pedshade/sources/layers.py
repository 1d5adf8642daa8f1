"""Polygon layers: a whitelist of layers, their inspection, and a scan that a box prunes.

A layer table has a row for each polygon: ``layer``, ``poly_id``, ``rings``
(structs x, y) or null, ``kind`` (the geometry's type), and the columns west,
south, east and north of its box, by whose minima and maxima a Parquet scan
skips row groups.  The definitions table has ``layer`` and ``include``: true,
false, or null while nobody has decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedshade.functions.geo import bbox_intersects
from pedshade.operators.cover import rings_box

POLYGONAL = ("Polygon", "MultiPolygon")


def with_boxes(polygons: DataFrame) -> DataFrame:
    """Rows with the columns of their box, as a layer table stores them."""
    box = rings_box(F.col("rings"))
    return polygons.withColumns({k: box[k] for k in ("west", "south", "east", "north")})


def meets(area: tuple[float, float, float, float]) -> Column:
    """Comparisons of plain columns, which reach the scan; touching counts."""
    return bbox_intersects(tuple(map(F.col, ("west", "south", "east", "north"))), tuple(map(F.lit, area)))


def valid_rings(rings: Column) -> Column:
    """A ring needs three distinct finite points; a polygon needs a ring."""
    ok = lambda r: (F.size(F.array_distinct(r)) >= 3) & F.forall(r, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    return F.coalesce((F.size(rings) > 0) & F.forall(rings, ok), F.lit(False))


def decided(definitions: DataFrame) -> DataFrame:
    """The definitions; a layer whose ``include`` is null is an error."""
    undecided = F.raise_error(F.concat(F.lit("undecided layer: "), F.col("layer"))).cast("boolean")
    return definitions.select("layer", F.when(F.col("include").isNull(), undecided).otherwise(F.col("include")).alias("include"))


def inspect_layers(polygons: DataFrame, definitions: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """``(layer, include, n_rows, n_intersecting, n_invalid, usable)``: one row for each layer that is defined.

    A layer that is included must hold polygons only to be usable.
    """
    counts = polygons.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(meets(area)).alias("n_intersecting"), F.count_if(~valid_rings(F.col("rings"))).alias("n_invalid"),
        F.count_if(~F.col("kind").isin(*POLYGONAL)).alias("_other"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return decided(definitions).join(counts, "layer", "left").select(
        "layer", "include", *[zero(F.col(c)).alias(c) for c in ("n_rows", "n_intersecting", "n_invalid")],
        (F.col("include") & (zero(F.col("n_rows")) > 0) & (zero(F.col("_other")) == 0)).alias("usable"),
    )


def read_layers(polygons: DataFrame, definitions: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """``(poly_id, layer, rings)`` of the included layers' polygons that meet the area; other kinds and invalid rings are left out."""
    wanted = decided(definitions).filter("include").select("layer")
    near = polygons.filter(meets(area) & F.col("kind").isin(*POLYGONAL))
    return near.join(wanted, "layer", "left_semi").filter(valid_rings(F.col("rings"))).select("poly_id", "layer", "rings")
