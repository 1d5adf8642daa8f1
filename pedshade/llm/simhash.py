"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into parts.  Each part has a covering code whose
words are the anchors: every value of the part lies within the code's covering
radius of an anchor.  Fingerprints at ``threshold`` or fewer differing bits
differ by at most ``slack`` bits in at least one part (the slacks are chosen
so that exceeding all of them takes more than ``threshold`` bits), so there one
of them, replicated to every anchor within radius + slack, meets the other at
the other's own anchor.  Compared per anchor, every link is found.

Codes: the perfect binary Golay code of 23 bits (radius 3, 4,096 anchors) for
two parts with slack 1, and the trivial code of radius 0 (each of the 2^18
values is an anchor) for the remaining bits, with slack 0.

Only distinct fingerprints are compared, and an anchor's output is a spanning
forest of its links, never its pairs.  Anchors with many fingerprints are
dealt out as a grid of blocks, so that no task holds a whole hot anchor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedshade.llm.common import bound_batches, bounds, in_blocks, is_hot, join_spread, key_of, utf8, whole_groups
from pedshade.operators.components import connected_components, label_min
from pedshade.runtime import Scratch

SHINGLE_WORDS = 4
THRESHOLD = 4
#: Longer texts are read in pieces of about this size.
LONG_BYTES = 2 << 20
_SPACE = re.compile(rb"[ \t-\r]")
#: Fingerprints of one anchor that are compared in one block of its grid.
BLOCK = 4096

#: Fixed value: generator polynomial of the binary Golay code,
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
GOLAY_BITS, GOLAY_RADIUS = 23, 3

#: (lowest bit, bits, slack) of each part.
PARTS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))


def bit_counts(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each run of hashes, how many have each of the 64 bits set.

    Bits are summed eight to a word, each in a byte of its own, over stretches
    of at most 255 hashes, in which no byte can overflow.
    """
    out = np.zeros((len(cuts) - 1, 64), np.int64)
    full = np.flatnonzero(np.diff(cuts) > 0)
    if not len(full):
        return out
    lo, n = cuts[full], np.diff(cuts)[full]
    stretches = -(-n // 255)
    owner = np.repeat(np.arange(len(full)), stretches)
    first = np.cumsum(stretches) - stretches
    at = lo[owner] + 255 * (np.arange(len(owner)) - first[owner])
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, at)
        out[full, bit::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def majority(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bits set in over half of ``n`` hashes, as unsigned numbers."""
    return ((counts * 2 > n[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def shingle_hashes(text: bytes | None, words: int = SHINGLE_WORDS) -> list[int]:
    """Unsigned XXH64, seed 42, of every shingle of the lower-cased text."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    h = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [h(joined, 42)]
    starts, at = [], 0
    for t in tokens:
        starts.append(at)
        at += len(t) + 1
    ends = [s - 1 for s in starts[words:]] + [len(joined)]
    return [h(joined[s:e], 42) for s, e in zip(starts, ends, strict=False)]


def long_counts(text: bytes, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, int]:
    """Bit counts and number of the shingles of a long text, read in pieces that share their border's words."""
    counts, n, before, at = np.zeros((1, 64), np.int64), 0, [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + LONG_BYTES)
        end = cut.start() if cut else len(text)
        tokens = before + text[at:end].lower().split()
        if len(tokens) >= words:
            h = np.array(shingle_hashes(b" ".join(tokens), words), np.uint64)
            counts += bit_counts(h, np.array([0, len(h)]))
            n += len(h)
        before = tokens[1 - words :]
        at = end
    if not n:  # fewer words than a shingle has
        h = np.array(shingle_hashes(b" ".join(before), words), np.uint64)
        counts, n = bit_counts(h, np.array([0, len(h)])), len(h)
    return counts, n


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, values in in_blocks(batches, "text"):
        flat: list[int] = []
        cuts = [0]
        for v in values:
            if v is None or len(v) <= LONG_BYTES:
                flat += shingle_hashes(v)
            cuts.append(len(flat))
        counts, n = bit_counts(np.array(flat, np.uint64), np.array(cuts)), np.diff(cuts)
        for i, v in enumerate(values):
            if v is not None and len(v) > LONG_BYTES:
                counts[i], n[i] = long_counts(v)
        kept = [c for c in rows.schema.names if c != "text"]
        fp = majority(counts, n).view(np.int64)
        yield pa.RecordBatch.from_arrays([*map(rows.column, kept), pa.array(fp)], names=[*kept, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, same, fp)`` of whole texts; null and empty texts have fingerprint zero, equal texts equal ``same``."""
    return bound_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), utf8().alias("text")
    ).mapInArrow(_fingerprint_batches, "doc_id long, same long, fp long")


@lru_cache(maxsize=1)
def golay_cosets() -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of weight radius + 1 and less, sorted by syndrome, and each syndrome's first.

    The anchors within that distance of x are x ^ e for the e that share x's
    syndrome; the first of each syndrome has weight radius or less and leads to
    x's own anchor.
    """
    patterns = np.array(
        [sum(1 << b for b in bits) for w in range(GOLAY_RADIUS + 2) for bits in combinations(range(GOLAY_BITS), w)],
        np.uint32,
    )
    s = golay_syndrome(patterns)
    order = np.argsort(s, kind="stable")
    return patterns[order], bounds(s[order])


def golay_syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator polynomial; zero for the code's words."""
    r = x.astype(np.uint32)
    for bit in range(GOLAY_BITS - 1, 10, -1):
        r = np.where(r >> np.uint32(bit) & np.uint32(1), r ^ np.uint32(GOLAY << (bit - 11)), r)
    return r


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, anchor, own)`` for every replica; an anchor's number names its part."""
    rows, keys, own = [], [], []
    for part, (shift, width, slack) in enumerate(PARTS):
        x = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        base = np.int64(part) << np.int64(24)
        if not slack:
            rows.append(np.arange(len(x)))
            keys.append(x.astype(np.int64) | base)
            own.append(np.ones(len(x), bool))
            continue
        patterns, first = golay_cosets()
        s = golay_syndrome(x)
        n = first[s + 1] - first[s]
        r = np.repeat(np.arange(len(x)), n)
        nth = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
        rows.append(r)
        keys.append((x[r].astype(np.uint32) ^ patterns[first[s[r]] + nth]).astype(np.int64) | base)
        own.append(nth == 0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def _own_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        _, key, own = anchors(pdf.fp.values.view(np.uint64))
        k, n = np.unique(key[own], return_counts=True)
        yield pd.DataFrame({"anchor": k, "n": n})


def _replicas(hot: dict[int, int]):
    """Rows (cell, fp, role): a cell is an anchor, or a block of a hot anchor's grid.

    role: 1 own anchor, 2 replica that looks for links, 3 both.
    """
    hot_keys = np.array(sorted(hot), np.int64)
    hot_n = np.array([hot[k] for k in sorted(hot)], np.int64)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for lo in range(0, len(whole), 20_000):
                fp = whole.fp.values[lo : lo + 20_000]
                row, key, own = anchors(fp.view(np.uint64))
                grid = np.ones(len(key), np.int64)
                if len(hot_keys):
                    at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                    grid = np.where(hot_keys[at] == key, hot_n[at], 1)
                plain = grid == 1
                yield pd.DataFrame({"cell": key[plain] << 32, "fp": fp[row[plain]], "role": np.where(own[plain], 3, 2).astype(np.int8)})
                if plain.all():
                    continue
                row, key, own, grid = row[~plain], key[~plain], own[~plain], grid[~plain]
                # A block number from the fingerprint, the same on every run.
                mine = (fp[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % grid
                rep = np.repeat(np.arange(len(row)), grid)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(grid) - grid, grid)
                looks = pd.DataFrame({"cell": (key[rep] << 32) | (other << 16) | mine[rep], "fp": fp[row[rep]], "role": np.int8(2)})
                rep, other = rep[own[rep]], other[own[rep]]
                stays = pd.DataFrame({"cell": (key[rep] << 32) | (mine[rep] << 16) | other, "fp": fp[row[rep]], "role": np.int8(1)})
                yield pd.concat([looks, stays], ignore_index=True)

    return run


def _linked(looks: np.ndarray, stays: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unequal fingerprints within the threshold, compared in blocks."""
    a, b = [], []
    step = max(1, (1 << 20) // max(1, len(stays)))
    for lo in range(0, len(looks), step):
        d = np.bitwise_count(looks[lo : lo + step, None] ^ stays[None, :])
        i, j = np.nonzero((d <= threshold) & (d > 0))
        if len(i):
            a.append(i + lo)
            b.append(j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _compare(threshold: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(parts, "cell"):
            fp, role, cut = pdf.fp.values.view(np.uint64), pdf.role.values, bounds(pdf.cell.values)
            us, vs = [], []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi - lo < 2:
                    continue
                f, r = fp[lo:hi], role[lo:hi]
                stays, looks = np.flatnonzero(r & 1), np.flatnonzero(r & 2)
                i, j = _linked(f[looks], f[stays], threshold)
                if not len(i):
                    continue
                ids, at = np.unique(f.view(np.int64), return_inverse=True)
                label = label_min(len(ids), at[looks[i]], at[stays[j]])
                moved = np.flatnonzero(label != np.arange(len(ids)))
                us.append(ids[label[moved]])
                vs.append(ids[moved])
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return run


def fingerprint_links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """A forest ``(u, v)`` over distinct ``fp`` whose trees are the linked sets.

    ``distinct`` is read twice, so hand over a written table.
    """
    if sum(slack + 1 for *_, slack in PARTS) <= threshold:
        raise ValueError("the parts' slacks do not cover this threshold")
    fps = distinct.select("fp")
    # At most one row for each anchor, of which the codes have 270,336 in all.
    hot = {
        r["anchor"]: -(-r["n"] // BLOCK)
        for r in fps.mapInPandas(_own_counts, "anchor long, n long")
        .groupBy("anchor")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > BLOCK)
        .collect()
    }
    return (
        fps.mapInPandas(_replicas(hot), "cell long, fp long, role byte")
        .repartition("cell")
        .sortWithinPartitions("cell")
        .mapInPandas(_compare(threshold), "u long, v long")
        .distinct()
    )


def simhash_groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    Needs columns doc_id and text; others are ignored.  Documents link where
    their fingerprints differ in ``threshold`` bits or fewer; component_id is
    the smallest doc_id reachable.  Null and empty texts have fingerprint zero
    and link like any other.  A null doc_id counts for links but never as the
    smallest; a component of null ids only has a null component_id.  Repeated
    rows come out repeated; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs))
    distinct = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    members = connected_components(fingerprint_links(distinct, threshold))
    linked = members.join(distinct, members.node == distinct.fp)
    roots = linked.groupBy("component").agg(F.min("least").alias("root"))
    of = linked.join(roots, "component").select("fp", "root")
    named = distinct.join(of, "fp", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    hot = distinct.filter(is_hot(F.col("n"), total)).select("fp")
    return join_spread(prints, named, ["fp"], hot, F.xxhash64("doc_id", "same")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each linked set.

    The row with the smallest doc_id stays, one with a null doc_id only where
    the set has no other; of rows that share that id the one with the smallest
    text hash, of equal rows one.  Sets whose rows share doc_ids keep a row each.
    Null and empty texts have fingerprint zero and link like any other; an empty
    table gives an empty one; columns of any name pass through.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs))
    # A row is known by its doc_id and text, since documents that don't link may share an id.
    rows_of = prints.groupBy("fp", "doc_id", "same").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), key_of().alias("key"), "same", "n")
    distinct = scratch.write(rows_of.groupBy("fp").agg(F.min(first).alias("first")))
    members = connected_components(fingerprint_links(distinct, threshold))
    sets = distinct.join(members, distinct.fp == members.node, "left").groupBy(F.coalesce("component", "fp").alias("component"))
    stay = scratch.write(sets.agg(F.min("first").alias("first")).select("first.key", "first.same", "first.n"))
    rows = docs.select(key_of().alias("key"), F.xxhash64("text").alias("same"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(stay.select("key", "same").hint("shuffle_hash"), ["key", "same"], "left_semi")
    if not stay.filter("n > 1").isEmpty():
        order = Window.partitionBy("key", "same").orderBy(F.xxhash64(F.col("row").cast("string")))
        kept = kept.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return kept.select("row.*")
