"""Ranks and exact quantiles by range-sorted tables, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedshade.runtime import Scratch


def gapless_rank(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with each row's gapless ``rank`` from 0 within its keys.

    Rows are sorted by range, so a key of any size spreads over the cluster;
    a window runs only over the counts, a row for each range and key.
    """
    scratch = Scratch(df.sparkSession, "ranks")
    placed = scratch.write(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_off", before - F.col("_first")).drop("_n", "_first")
    return placed.join(offsets, [*keys, "_range"]).withColumn("rank", F.col("_at") + F.col("_off")).drop("_at", "_range", "_off")


def quantiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """``(*keys, q)``: exact quantiles, interpolated between neighbours, as an array in the order of ``at``.

    Nulls are left out; a key without values has no row.  Keys must not be
    null.  Equal values are counted before any row moves, so that a column of
    few values stays small, and the distinct ones are sorted by range, so that
    a key of many values spreads over the cluster.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null")
    counted = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    held = counted.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v").withColumn("_range", F.spark_partition_id())
    held = Scratch(df.sparkSession, "quantiles").write(held)
    # Rows of each range and key, and how many come before them: a row for each range and key.
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = held.groupBy(*keys, "_range").agg(F.sum("n").alias("n"))
    of_key = Window.partitionBy(*keys or [F.lit(0)])
    sizes = sizes.select(*keys, "_range", "n", before(of_key.orderBy("_range")).alias("_off"), F.sum("n").over(of_key).alias("_all"))
    place = [F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("_all") - 1)).alias("p")) for i, p in enumerate(at)]
    # Each wanted rank is looked up in the range that holds it.
    wanted = sizes.select(*keys, "_range", "n", "_off", F.inline(F.array(*place)))
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("p"), F.ceil("p")))).alias("rank"))
    wanted = wanted.filter((F.col("rank") >= F.col("_off")) & (F.col("rank") < F.col("_off") + F.col("n")))
    wanted = wanted.select(*keys, "_range", "i", "p", (F.col("rank") - F.col("_off")).alias("rank"), F.col("rank").alias("_nth"))
    inside = before(Window.partitionBy(*keys, "_range").orderBy("v"))
    spans = held.select(*keys, "_range", "v", inside.alias("lo"), (inside + F.col("n")).alias("hi"))
    found = wanted.join(spans, [*keys, "_range"]).filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    low, high = F.min_by("v", "_nth"), F.max_by("v", "_nth")
    share = F.first("p") - F.floor(F.first("p"))
    each = found.groupBy(*keys, "i").agg((low + (high - low) * share).alias("q"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))
