"""Connected components of an undirected edge table: stars inside partitions, then alternating stars between them.

Edges are dealt out by ranges of ids, and a union-find inside each partition
turns them into stars.  Vertices that stand in several stars link those
stars' roots, and only these links, not the whole table, go through rounds:
each replaces a root's links by links to its smallest neighbour, first for the
larger neighbours, then for the smaller ones; the link count never grows and
the rounds needed grow with the logarithm of the links' diameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedshade.runtime import Scratch, digest_of


def label_min(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` vertices over pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        ra, rb = label[a], label[b]
        low = np.minimum(ra, rb)
        np.minimum.at(label, ra, low)
        np.minimum.at(label, rb, low)
        while not np.array_equal(up := label[label], label):
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


#: Edges that a task holds at once while it contracts them.
CONTRACT_EDGES = 1 << 20


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars (u, v) over a partition's edges, a row for each vertex v but the roots u, where they fit in one piece."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> tuple[np.ndarray, np.ndarray]:
        u, v = (np.concatenate(c) for c in zip(*held, strict=True))
        ids, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = label_min(len(ids), inv[: len(u)], inv[len(u) :])
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return ids[label[moved]], ids[moved]

    rows = 0
    for pdf in parts:
        held.append((pdf.u.to_numpy(), pdf.v.to_numpy()))
        rows += len(pdf)
        if rows >= CONTRACT_EDGES:
            held = [stars()]
            rows = len(held[0][0])
            # Stars that leave no room for more edges are let go; other partitions and rounds link them.
            if 2 * rows >= CONTRACT_EDGES:
                yield pd.DataFrame(dict(zip("uv", held[0], strict=True)))
                held, rows = [], 0
    if rows:
        yield pd.DataFrame(dict(zip("uv", stars(), strict=True)))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("m").alias("u"), "v")


def _small_star(e: DataFrame) -> DataFrame:
    # e holds (u, v) with u < v: v's smaller neighbours are its rows' u.
    low = e.groupBy("v").agg(F.min("u").alias("m"))
    moved = e.join(low, "v").filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return low.select(F.col("m").alias("u"), "v").unionByName(moved)


def _settled(links: DataFrame, scratch: Scratch, max_rounds: int) -> DataFrame:
    """Stars (u, v) of whole components over links with u < v, by rounds."""
    e = scratch.write(links.mapInPandas(_contract, "u long, v long").distinct())
    seen = digest_of(e)
    for _ in range(max_rounds):
        if not seen[0]:
            return e
        grown = scratch.write(_small_star(_large_star(e).distinct()).distinct())
        now = digest_of(grown)
        scratch.drop(e)
        e = grown
        if now == seen:
            return e
        seen = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every vertex that has a link.

    ``component`` is the smallest vertex reachable.  Nulls and loops in
    ``edges`` link nothing and are left out; repeated and reversed rows are
    one link; an empty table gives an empty one.  Vertices must be integers.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(
        F.least(src, dst).cast("long").alias("u"), F.greatest(src, dst).cast("long").alias("v")
    ).filter("u < v")
    # Written first, as the ranges are found by a look at all of it.
    e = scratch.write(e.mapInPandas(_contract, "u long, v long"))
    stars = scratch.write(e.repartitionByRange("u").mapInPandas(_contract, "u long, v long"))
    scratch.drop(e)
    # A vertex and the roots of the stars that it stands in; a root stands in its own.
    in_stars = stars.select("v", "u").unionByName(stars.select(F.col("u").alias("v"), "u").distinct())
    placed = scratch.write(in_stars.groupBy("v").agg(F.min("u").alias("low"), F.max("u").alias("high")))
    shared = placed.filter("low < high").select("v", "low")
    links = in_stars.join(shared, "v").filter("u > low").select(F.col("low").alias("u"), F.col("u").alias("v")).distinct()
    roots = _settled(links, scratch, max_rounds)
    out = placed.join(roots.select(F.col("v").alias("low"), "u"), "low", "left")
    return out.select(F.col("v").alias("node"), F.coalesce("u", "low").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


def largest_components(components: DataFrame, k: int) -> DataFrame:
    """The k largest components; ties go to the smaller component id."""
    w = Window.orderBy(F.desc("n_nodes"), "component")
    return component_sizes(components).orderBy(F.desc("n_nodes"), "component").limit(k).withColumn(
        "rank", F.row_number().over(w)
    )
