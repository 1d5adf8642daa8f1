"""Sharding by balanced label propagation under the law of equal row counts.

Documents with equal texts are linked; a link between shards is a cut edge.
Shards begin as equal stretches of doc_id order.  In each round every group
finds the shard that holds most of it, and its other members ask to move
there.  Quotas for each pair of shards keep every shard's size: what a shard
takes in beyond what it gives away it balances with documents that have no
links, and where those do not suffice fewer requests are granted.  Counts stay
at most one apart in every round.

A group larger than three quarters of a shard is first dealt into parts of about
that size at most, so that no key holds more rows than a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedshade.llm.common import is_hot, join_spread, key_of
from pedshade.runtime import Scratch

SHARDS = 24
ROUNDS = 4


def ranked(df: DataFrame, cls: Column, order: list[Column], scratch: Scratch) -> tuple[DataFrame, dict[int, int]]:
    """``df`` with ``_class`` and each row's gapless rank within its class as ``_rank``; and the classes' row counts.

    Rows are sorted by range, so a class of any size spreads over the
    cluster; only one count for each range and class goes to the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = (
        df.withColumn("_class", cls.cast("long"))
        .repartitionByRange(n, "_class", *order)
        .sortWithinPartitions("_class", *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    sorted_ = scratch.write(sorted_).withColumn("_range", F.shiftright("_at", 33))
    counts = sorted(
        (r["_class"], r["_range"], r["first"], r["n"])
        for r in sorted_.groupBy("_class", "_range").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    )
    seen: dict[int, int] = {}
    offsets = []
    for c, p, first, k in counts:
        offsets.append((c, p, seen.get(c, 0) - first))
        seen[c] = seen.get(c, 0) + k
    table = spark.createDataFrame(offsets, "_class long, _range long, _off long")
    out = (
        sorted_.join(F.broadcast(table), ["_class", "_range"])  # a row for each range and class at most
        .withColumn("_rank", F.col("_at") + F.col("_off"))
        .drop("_at", "_off", "_range")
    )
    return out, seen


def quotas(asked: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many requests to grant, and how many unlinked rows to move, from shard to shard.

    Every row sum equals its column sum over both, and no shard sends away
    more unlinked rows than it has.
    """
    granted = asked.astype(np.int64).copy()
    np.fill_diagonal(granted, 0)
    while True:
        surplus = granted.sum(axis=0) - granted.sum(axis=1)
        over = np.flatnonzero(surplus > free)
        if not len(over):
            break
        t = int(over[np.argmax((surplus - free)[over])])
        cut = int(surplus[t] - free[t])
        column = granted[:, t]
        less = np.minimum(column, -(-column * cut // max(1, column.sum())))
        granted[:, t] = column - less
    moves = np.zeros_like(granted)
    give, take = np.maximum(surplus, 0), np.maximum(-surplus, 0)
    s = t = 0
    while s < len(give) and t < len(take):
        n = min(give[s], take[t])
        moves[s, t] += n
        give[s] -= n
        take[t] -= n
        done = give[s] == 0, take[t] == 0
        s, t = s + done[0], t + done[1]
    return granted, moves


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shard and slot of every row of ``docs``, and sizes and checksums of the texts.

    Needs columns doc_id and text; others are ignored.  ``size`` is the
    text's UTF-8 bytes plus 8, ``text_crc32`` its checksum (null counts as
    empty), ``group_parts`` the number of parts that the row's group of equal
    texts was dealt into (0 for a text that occurs once).  A null doc_id comes
    first; repeated rows get slots of their own; an empty table gives an empty
    one; with fewer rows than shards, some shards stay empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        key_of().alias("_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_g1"),
        F.xxhash64(F.lit(1), text).alias("_g2"),
    )
    rows, count = ranked(rows, F.lit(0), [F.col("_key"), F.col("_g1"), F.col("size")], scratch)
    rows = rows.withColumnRenamed("_rank", "_i").drop("_class")
    total = count.get(0, 0)
    part = max(1, 3 * total // (4 * shards))
    groups = (
        rows.groupBy("_g1", "_g2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("_g1", "_g2", "n", F.ceil(F.col("n") / F.lit(part)).cast("long").alias("group_parts"))
    )
    groups = scratch.write(groups)
    parts = F.coalesce("group_parts", F.lit(0))
    row = F.xxhash64("_key", "_i")
    state = scratch.write(
        join_spread(rows, groups.drop("n"), ["_g1", "_g2"], groups.filter(is_hot(F.col("n"), total)), row)
        .withColumn("group_parts", parts)
        .withColumn("_part", F.when(F.col("group_parts") > 0, F.xxhash64("_g1", "_g2", F.pmod(F.xxhash64("_key", "_i"), F.col("group_parts")))))
        .withColumn("shard", F.floor(F.col("_i") * shards / max(1, total)).cast("long"))
        .drop("_g1", "_g2")
    )
    for _ in range(rounds if total else 0):
        linked = state.filter(F.col("_part").isNotNull())
        held = linked.groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("n"))
        best = scratch.write(held.groupBy("_part").agg(F.max_by("shard", F.struct("n", F.xxhash64("_part", "shard"))).alias("_to"), F.sum("n").alias("n")))
        # Rows without a part get a key of their own, so that they spread; as a hash it could be a part's, so it counts for none.
        lone = F.col("_part").isNull()
        keyed = state.withColumns({"_lone": lone, "_part": F.coalesce("_part", row)})
        aims = join_spread(keyed, best.drop("n"), ["_part"], best.filter(is_hot(F.col("n"), total)), row)
        to = F.when(F.col("_lone"), F.lit(shards)).otherwise(F.coalesce("_to", F.lit(shards))).cast("long")
        aims = aims.withColumns({"_to": to, "_part": F.when(~F.col("_lone"), F.col("_part"))}).drop("_lone")
        # A class for each shard and the shard its rows ask for, or none: at most shards * (shards + 1).
        lined, count = ranked(aims, F.col("shard") * (shards + 1) + F.col("_to"), [F.col("_part"), F.col("_key"), F.col("_i")], scratch)
        asked, free = np.zeros((shards, shards), np.int64), np.zeros(shards, np.int64)
        for c, n in count.items():
            s, t = divmod(c, shards + 1)
            if t == shards:
                free[s] = n
            elif t != s:
                asked[s, t] = n
        granted, moves = quotas(asked, free)
        if not granted.any():
            break
        ranges = []  # (class, first rank, rank after the last, new shard)
        for s in range(shards):
            ranges += [(s * (shards + 1) + t, 0, int(granted[s, t]), t) for t in np.flatnonzero(granted[s]).tolist()]
            at = 0
            for t in np.flatnonzero(moves[s]).tolist():
                ranges.append((s * (shards + 1) + shards, at, at + int(moves[s, t]), t))
                at += int(moves[s, t])
        table = spark.createDataFrame(ranges, "_class long, _lo long, _hi long, _new long")
        moved = lined.join(
            F.broadcast(table),  # at most shards * (2 shards + 1) rows
            (lined["_class"] == table["_class"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")),
            "left",
        ).drop("_class", "_rank", "_lo", "_hi", "_to")
        state = moved.withColumn("shard", F.coalesce("_new", "shard")).drop("_new")
        if (granted == asked).all():
            break
        state = scratch.write(state)
    out, _ = ranked(state, F.col("shard"), [F.col("_key"), F.col("_i")], scratch)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("_rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_parts",
    )


def cut_edges(sharded: DataFrame, docs: DataFrame) -> DataFrame:
    """Links a group's rows have to a row in another shard, with each group's rows in a star: one row of counts."""
    by = docs.select(F.col("doc_id"), F.xxhash64("text").alias("g")).join(sharded.select("doc_id", "shard"), "doc_id")
    held = by.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("g").agg((F.sum("n") - F.max("n")).alias("c"), F.sum("n").alias("t")).agg(
        F.sum("c").alias("cut"), F.sum(F.col("t") - 1).alias("links")
    )
