"""Benchmark decontamination by spaced seeds.

A seed hashes the words at a mask's positions and ignores those between, so a
replaced word there does not hide a copied passage.  Seeds of documents join
the benchmark's seeds by hash.  Each seed carries the words around it, so a
hit is verified where it is joined, substitutions allowed.

A document holds a passage of an item where ``WINDOW`` aligned words differ in
``SUBSTITUTIONS`` places or fewer; an item of ``SHORT`` to ``WINDOW`` - 1 words
must be there whole with one difference at most.  The two masks lose none of
these: every placing of two differences in 12 or 13 words, and of one in 8,
leaves a place for one of the masks.

Seeds of documents pass a bitmap of the benchmark's seeds first, so that only
few are shuffled.  Its size is bounded (2^26 bits), whatever the benchmark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedshade.llm.common import bound_batches, in_blocks, key_of, mix64, utf8, word_hashes
from pedshade.runtime import Scratch

#: Word positions that a seed reads.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 4))
WINDOW, SUBSTITUTIONS = 13, 2
SHORT = 8
#: Words before and after a seed's first that any window over the seed can reach.
BEFORE, AFTER = WINDOW - len(MASKS[1]), WINDOW - 1
AROUND = BEFORE + 1 + AFTER
#: Bounds of the bitmap's size, as powers of two.
LEAST_BITS, MOST_BITS = 16, 26
#: Words whose seeds are computed at once.
STEP = 1 << 19
#: Seeds that hold over a thousandth of all hits, and at least this many, are dealt over ``SALTS`` tasks.
HOT, SALTS = 20_000, 64


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = max(0, len(words) - mask[-1])
    h = np.full(n, np.uint64(mask[-1] + 1))
    for at in mask:
        h = mix64(h * np.uint64(0x100000001B3) + words[at : at + n])
    return h


def _bits_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's two places in the bitmap."""
    low = np.uint64((1 << bits) - 1)
    return ((h >> np.uint64(64 - bits)) & low).astype(np.int64), ((h >> np.uint64(64 - 2 * bits)) & low).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, size * (len(rows) + 1), size, dtype=np.int32) if len(rows) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


_SEEDS = "key long, same long, hash long, at int, n int, around binary"


def _seeds(bitmap, bits: int, least: int):
    """Seeds that lie whole in one text of ``least`` words or more and pass the bitmap, each with the words around it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = None if bitmap is None else bitmap.value
        for rows, values in in_blocks(batches, "text"):
            words, ends = word_hashes(values)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            key, same = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            near = np.zeros(len(words) + AROUND, np.uint32)
            near[BEFORE : BEFORE + len(words)] = words.astype(np.uint32)
            windows = np.lib.stride_tricks.sliding_window_view(near, AROUND)
            for lo in range(0, len(words), STEP):
                for mask in MASKS:
                    h = seed_hashes(words[lo : lo + STEP + mask[-1]], mask)
                    some = np.arange(len(h))
                    if maybe is not None:
                        one, two = _bits_of(h, bits)
                        some = np.flatnonzero(maybe[one >> 3] >> (one & 7).astype(np.uint8) & 1)
                        two = two[some]
                        some = some[(maybe[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)]
                    at = some + lo
                    doc = np.searchsorted(ends, at, "right")
                    whole = (at + mask[-1] < ends[doc]) & (ends[doc] - starts[doc] >= least)
                    some, at, doc = some[whole], at[whole], doc[whole]
                    for k in range(0, len(at), 50_000):
                        s, a, d = some[k : k + 50_000], at[k : k + 50_000], doc[k : k + 50_000]
                        arrays = [pa.array(key[d]), pa.array(same[d]), pa.array(h[s].view(np.int64)), pa.array((a - starts[d]).astype(np.int32)),
                                  pa.array((ends[d] - starts[d]).astype(np.int32)), _binary(windows[a])]
                        yield pa.RecordBatch.from_arrays(arrays, names=["key", "same", "hash", "at", "n", "around"])

    return run


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return bound_batches(df).select(key_of(key).alias("key"), F.xxhash64("text").alias("same"), utf8().alias("text"))


_HITS = "key long, same long, t long, diagonal int, at int, first int, last int, equal int"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of joined hits those with a window over the seed that differs little enough.

    ``first`` and ``last`` bound the words of all such windows, ``equal`` has
    a bit for each equal word between them, from ``BEFORE`` words before the seed.
    """
    for batch in batches:
        for cut in range(0, batch.num_rows, 50_000):
            b = batch.slice(cut, 50_000)
            key, same, t, at, n, iat, m = (b.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            mine, theirs = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, AROUND) for k in (7, 8))
            equal = mine == theirs
            differs = np.zeros((len(at), AROUND + 1), np.int8)
            np.cumsum(~equal, axis=1, out=differs[:, 1:])
            first, last = np.full(len(at), AROUND, np.int64), np.full(len(at), -1, np.int64)
            long_item = m >= WINDOW
            for s in range(AROUND - WINDOW + 1):
                inside = (at - BEFORE + s >= 0) & (at - BEFORE + s + WINDOW <= n) & (iat - BEFORE + s >= 0) & (iat - BEFORE + s + WINDOW <= m)
                good = long_item & inside & (differs[:, s + WINDOW] - differs[:, s] <= SUBSTITUTIONS)
                first[good] = np.minimum(first[good], s)
                last[good] = s + WINDOW - 1
            short = np.flatnonzero(~long_item & (at >= iat) & (at - iat + m <= n))
            s, e = BEFORE - iat[short], BEFORE - iat[short] + m[short]
            good = differs[short, e] - differs[short, s] <= 1
            first[short[good]], last[short[good]] = s[good], e[good] - 1
            ok = np.flatnonzero(last >= 0)
            place = np.arange(AROUND)
            bits = (equal[ok] & (place >= first[ok, None]) & (place <= last[ok, None])) @ (1 << place)
            base = at[ok] - BEFORE
            columns = [key[ok], same[ok], t[ok], *(x.astype(np.int32) for x in (at[ok] - iat[ok], at[ok], base + first[ok], base + last[ok], bits))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _HITS.split(", ")])


def _bitmap(seeds: DataFrame, bits: int):
    """The benchmark's seeds as a bitmap, put together by aggregation: 2^bits bits, 8 MB at most."""
    h, low = F.col("hash"), F.lit((1 << bits) - 1)
    places = seeds.select(F.explode(F.array(F.shiftrightunsigned(h, 64 - bits), F.shiftrightunsigned(h, 64 - 2 * bits))).alias("p"))
    places = places.select((F.col("p").bitwiseAND(low) + 1).alias("p"))
    parts = places.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b")).collect()
    out = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
    for r in parts:
        part = np.frombuffer(r["b"], np.uint8)
        out[(r["k"] - 1) * 4096 :][: len(part)] = part[: len(out) - (r["k"] - 1) * 4096]
    return seeds.sparkSession.sparkContext.broadcast(out)


def found_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(key, same, item_id, n_equal, first_word, n_words)``, written: items in each distinct document.

    A document is known by its doc_id and its text's hash.  ``n_equal`` counts
    the equal words of all windows that match along one alignment, ``n_words``
    reaches from the first to the last of them.  Of an item's alignments, and of
    the texts that share its id, the one with most equal words counts, then the
    earliest, then the shortest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = _keyed(benchmark.filter("text is not null and item_id is not null"), "item_id")
    members = items.select(F.col("same").alias("t"), F.col("key").alias("item_id")).distinct()
    texts = items.dropDuplicates(["same"]).select(F.lit(0).cast("long").alias("key"), "same", "text")
    seeds = scratch.write(
        texts.mapInArrow(_seeds(None, 0, SHORT), _SEEDS)
        .select("hash", F.col("same").alias("t"), F.col("at").alias("iat"), F.col("n").alias("m"), F.col("around").alias("theirs"))
    )
    n = seeds.count()
    bits = max(LEAST_BITS, min(MOST_BITS, (64 * n).bit_length()))
    ours = scratch.write(_keyed(docs, "doc_id").mapInArrow(_seeds(_bitmap(seeds, bits), bits, SHORT), _SEEDS))
    # A seed of very many documents or items is dealt over many tasks.  At most a thousand are so on either side.
    hot = None
    for side in (ours, seeds):
        total = F.sum("n").over(Window.partitionBy(F.lit(0)))
        counts = side.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
        some = counts.withColumn("all", total).filter(F.col("n") * 1000 > F.col("all")).select("hash")
        hot = some if hot is None else hot.unionByName(some)
    hot = F.broadcast(scratch.write(hot.distinct().withColumn("hot", F.lit(True))))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key", "same", "at"), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = ours.join(hot, "hash", "left").withColumn("salt", salt).drop("hot")
    right = seeds.join(hot, "hash", "left").withColumn("salt", F.explode(every)).drop("hot")
    joined = left.join(right, ["hash", "salt"]).select("key", "same", "t", "at", "n", "iat", "m", "around", "theirs")
    hits = (
        joined.mapInArrow(_verified, _HITS).groupBy("key", "same", "t", "diagonal", "at")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bit_or("equal").alias("equal"))
    )
    # Along an alignment both ends of the windows over a seed move on with the seed,
    # so what a hit adds to those before it lies after their last word.
    before = F.lag("last").over(Window.partitionBy("key", "same", "t", "diagonal").orderBy("at"))
    fresh = hits.withColumn("_from", F.greatest("first", F.coalesce(before + 1, "first")))
    added = F.expr(f"bit_count(shiftrightunsigned(equal, _from - (at - {BEFORE})))")
    lines = fresh.groupBy("key", "same", "t", "diagonal").agg(
        F.sum(added).alias("n_equal"), F.min("first").cast("long").alias("first_word"), (F.max("last") + 1 - F.min("first")).cast("long").alias("n_words")
    )
    best = F.min(F.struct((-F.col("n_equal")).alias("worse"), "first_word", "n_words"))
    found = lines.join(members, "t").groupBy("key", "same", "item_id").agg(best.alias("b"))
    return scratch.write(found.select("key", "same", "item_id", (-F.col("b.worse")).alias("n_equal"), "b.first_word", "b.n_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_equal, first_word, n_words)``: passages of items in documents.

    One row for each row of ``docs`` and item found in it, as
    :func:`found_passages` describes.  Words are lower-cased runs of letters
    and digits.  Items of fewer than ``SHORT`` words, null items and null texts
    match nothing; an item_id with several texts is one item; a null doc_id is
    kept; rows repeated in ``docs`` come out repeated, rows repeated in
    ``benchmark`` do not; other columns are ignored; either table may be empty.
    """
    found = found_passages(docs, benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of().alias("key"), F.xxhash64("text").alias("same"))
    return rows.join(found, ["key", "same"]).select("doc_id", "item_id", "n_equal", "first_word", "n_words")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no passage of the benchmark.

    Rows with a null doc_id or null text, repeated rows and rows that share a
    doc_id are judged each by its own text; an empty table, or an empty
    benchmark, drops nothing; columns of any name pass through.
    """
    gone = found_passages(docs, benchmark).select("key", "same").distinct()
    rows = docs.select(key_of().alias("key"), F.xxhash64("text").alias("same"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, ["key", "same"], "left_anti").select("row.*")
