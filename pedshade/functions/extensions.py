"""Functions that users bring or call in SQL: costs in Python, and intervals as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pedshade.operators.polygons import line_intervals


def cost_function(fn: Callable[..., np.ndarray], *columns: str | Column) -> Column:
    """A cost for :func:`pedshade.operators.routing.shortest_paths` from a function over arrays of the columns' values.

    ``fn`` gets a numpy array a column, null as NaN, and returns one cost a
    row; it runs on Arrow batches in the tasks.  Another number of costs is an
    error, as are costs that are null, NaN, infinite or negative once paths are
    searched.
    """

    def cost(*arrays: pa.Array) -> pa.Array:
        values = [pa.compute.fill_null(a.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for a in arrays]
        out = np.asarray(fn(*values), np.float64)
        if out.shape != (len(arrays[0]),):
            raise ValueError(f"the cost function gave shape {out.shape} for {len(arrays[0])} edges")
        return pa.array(out)

    cost.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    return F.arrow_udf(cost, "double")(*columns)


def _points(of: object, rings: bool) -> bool:
    """Whether a type is an array of structs (x, y), or of arrays of them."""
    if rings:
        return isinstance(of, ArrayType) and _points(of.elementType, False)
    point = of.elementType if isinstance(of, ArrayType) else None
    return isinstance(point, StructType) and {"x", "y"} <= {f.name for f in point.fields if isinstance(f.dataType, DoubleType)}


class LineIntervals:
    """``line_intervals(line, rings)``: the stretches (s, e) of a line inside a polygon, from the line's start.

    ``line`` is an array of structs (x, y), ``rings`` an array of such arrays;
    other types are refused when the query is analysed.  Null gives no row.
    """

    @staticmethod
    def analyze(line: AnalyzeArgument, rings: AnalyzeArgument) -> AnalyzeResult:
        for name, given, nested in (("line", line, False), ("rings", rings, True)):
            if given.isTable or not _points(given.dataType, nested):
                raise ValueError(f"{name} must hold structs of doubles x and y")
        return AnalyzeResult(StructType().add("s", "double", False).add("e", "double", False))

    def eval(self, line, rings) -> Iterator[tuple[float, float]]:
        if line is None or rings is None:
            return
        at = lambda points: np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)
        for s, e in line_intervals(at(line), [at(r) for r in rings]):
            yield float(s), float(e)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to a session's SQL."""
    spark.udtf.register("line_intervals", F.udtf(LineIntervals))
