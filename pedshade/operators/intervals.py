"""Interval sets along an edge: merge, subtract, measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-9


def normalized(intervals: DataFrame, s: str = "s", e: str = "e") -> DataFrame:
    """Reversed intervals turned, those shorter than ``EPSILON`` dropped."""
    lo, hi = F.least(s, e), F.greatest(s, e)
    return intervals.withColumns({s: lo, e: hi}).filter(F.col(e) - F.col(s) > EPSILON)


def merge(intervals: DataFrame, keys: list[str], s: str = "s", e: str = "e") -> DataFrame:
    """Disjoint intervals of each key; gaps up to ``EPSILON`` close."""
    before = Window.partitionBy(*keys).orderBy(s, e).rowsBetween(Window.unboundedPreceding, -1)
    # Equal intervals are of one island, whichever of them came first above.
    upto = Window.partitionBy(*keys).orderBy(s, e).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(e).over(before)
    marked = normalized(intervals.select(*keys, s, e), s, e).withColumn("_new", (reach.isNull() | (F.col(s) > reach + F.lit(EPSILON))).cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(upto))
    return island.groupBy(*keys, "_island").agg(F.min(s).alias(s), F.max(e).alias(e)).drop("_island")


def subtract(left: DataFrame, right: DataFrame, keys: list[str], s: str = "s", e: str = "e") -> DataFrame:
    """What of ``left`` no interval of ``right`` covers, by one sweep over all ends; overlaps on a side only deepen it."""
    events = None
    for df, side in ((normalized(left, s, e), "l"), (normalized(right, s, e), "r")):
        for at, sign in ((s, 1), (e, -1)):
            part = df.select(*keys, F.col(at).alias("p"), F.lit(sign if side == "l" else 0).alias("dl"), F.lit(sign if side == "r" else 0).alias("dr"))
            events = part if events is None else events.unionByName(part)
    points = events.groupBy(*keys, "p").agg(F.sum("dl").alias("dl"), F.sum("dr").alias("dr"))
    w = Window.partitionBy(*keys).orderBy("p")
    depth = points.select(*keys, "p", F.lead("p").over(w).alias("q"), F.sum("dl").over(w).alias("l"), F.sum("dr").over(w).alias("r"))
    inside = depth.filter("l > 0 and r = 0 and q is not null").select(*keys, F.col("p").alias(s), F.col("q").alias(e))
    return merge(inside, keys, s, e)


def covered_ratio(shadow: DataFrame, footprint: DataFrame, lengths: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """Share of each length under shadow but not under a footprint, held in [0, 1].

    ``lengths`` has a row for each key; keys without shadow have 0.
    """
    measure = subtract(shadow, footprint, keys).groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    ratio: Column = F.try_divide(F.coalesce("covered", F.lit(0.0)), F.nullif(F.col(length), F.lit(0.0)))
    return lengths.join(measure, keys, "left").select(*keys, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(ratio, F.lit(0.0)))).alias("ratio"))
