"""Helpers that several text operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id wherever documents are ordered or joined: nulls come first.
NULL_ID = -(2**63)

#: Bytes of text that a numpy kernel handles at once; bounds its temporaries.
BLOCK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of rows that Spark hands to a Python worker at once; Spark's default is 64 MB.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(docs: DataFrame) -> DataFrame:
    """``docs``; the session's Arrow batches shrink to ``BATCH_BYTES`` unless they were set by hand.

    A worker holds a batch several times over, as bytes, values and results.
    """
    conf = docs.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return docs


def key_of(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def utf8(col: str = "text") -> Column:
    """The text as bytes, so that Arrow hands Python its UTF-8 unchanged."""
    return F.encode(F.col(col), "UTF-8")


def in_blocks(batches: Iterator[pa.RecordBatch], col: str, limit: int = BLOCK_BYTES, most: int = 1 << 30):
    """``(rows, values)`` of about ``limit`` bytes and ``most`` rows; one long text may exceed it.

    Where there is no column ``col`` of bytes, it is the text of that name in
    the struct that comes first.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(col)
        column = batch.column(at) if at >= 0 else pa.compute.struct_field(batch.column(0), col).cast(pa.binary())
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        block = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(block)) + 1, np.arange(most, len(block), most)]))
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo), column.slice(lo, hi - lo).to_pylist()


#: A key is hot where it holds over a thousandth of all rows, and at least this many: at most a thousand keys are.
HOT_ROWS = 1000


def is_hot(n: Column, total: int) -> Column:
    return (n > HOT_ROWS) & (n * 1000 > F.lit(total))


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: Column) -> DataFrame:
    """``left`` with the other columns of ``right``, null without a match; no task gets all rows of a hot key.

    ``right`` has one row for each key.  The rows of the keys in ``hot``, at
    most a thousand (see :func:`is_hot`), are broadcast; rows of ``left`` that
    found theirs go by ``spread`` through the join of the others.
    """
    names = [c for c in right.columns if c not in keys]
    few = right.join(F.broadcast(hot.select(*keys)), keys, "left_semi").select(*keys, F.struct(*names).alias("_hot"))
    marked = left.join(F.broadcast(few), keys, "left")
    rest = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.struct(*names).alias("_rest"))
    first = F.when(F.col("_hot").isNull(), F.col(keys[0])).otherwise(spread)
    on = (first == F.col("_r0")) & F.col("_hot").isNull()
    for i, k in enumerate(keys[1:], 1):
        on = on & (F.col(k) == F.col(f"_r{i}"))
    found = F.coalesce("_hot", "_rest")
    return marked.join(rest, on, "left").select(*left.columns, *[found[c].alias(c) for c in names])


def whole_groups(parts: Iterator[pd.DataFrame], key: str, least: int = 50_000) -> Iterator[pd.DataFrame]:
    """Regroups rows sorted by ``key`` into frames that hold every key whole.

    Frames have about ``least`` rows, more where one key has more.
    """
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in parts:
        if not len(pdf):
            continue
        held.append(pdf)
        n += len(pdf)
        if n < least:
            continue
        keys = pdf[key].values
        at = int(np.searchsorted(keys, keys[-1], "left")) if keys[0] <= keys[-1] else 0
        if at == 0 and (len(held) == 1 or held[-2][key].values[-1] == keys[0]):
            continue
        held[-1] = pdf.iloc[:at]
        yield pd.concat([h for h in held if len(h)], ignore_index=True)
        held, n = [pdf.iloc[at:]], len(pdf) - at
    if n:
        yield pd.concat([h for h in held if len(h)], ignore_index=True)


def bounds(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the length as the last entry."""
    n = len(sorted_values)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [n]])


def load64(buf: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit word at every offset; ``buf`` needs 8 spare bytes."""
    return np.ndarray(len(buf) - 7, "<u8", buf, 0, (1,))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MUL
    return x ^ (x >> np.uint64(32))


#: Bytes of text whose words are hashed at once; longer texts are cut between words.
PIECE_BYTES = 4 << 20
_BREAK = re.compile(rb"[\x00-\x2f:-@\[-`{-\x7f]")


def pieces(raw: bytes, limit: int | None = None) -> Iterator[bytes]:
    """A text's bytes in pieces of about ``limit``, cut where no word stands; a longer word stays whole."""
    limit = limit or PIECE_BYTES
    at = 0
    while at < len(raw):
        cut = _BREAK.search(raw, at + limit)
        end = cut.start() if cut and at + limit < len(raw) else len(raw)
        yield raw[at:end]
        at = end


def word_hashes(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the words' cumulative count by text.

    A word is a run of ASCII letters and digits and non-ASCII characters after
    ASCII lower-casing; words of equal bytes have equal 64-bit hashes.
    """
    if sum(len(v or b"") for v in values) <= PIECE_BYTES:
        return _word_hashes(values)
    hashes, ends = [], []
    for v in values:
        hashes += [_word_hashes([p])[0] for p in pieces(v or b"")]
        ends.append(len(hashes))
    sizes = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), sizes[ends]


def _word_hashes(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"\0".join(v or b"" for v in values).lower() + bytes(16)
    buf = np.frombuffer(raw, np.uint8)
    is_word = _WORD[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if is_word[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    left = end - start
    loads = load64(buf)
    h = left.astype(np.uint64) * _MUL
    at, todo = start.copy(), np.arange(len(start))
    while len(todo):
        n = np.minimum(left[todo], 8).astype(np.uint64)
        chunk = loads[at[todo]] << ((np.uint64(8) - n) * np.uint64(8))
        h[todo] = mix64(h[todo] * _MUL + chunk)
        at[todo] += 8
        left[todo] -= 8
        todo = todo[left[todo] > 0]
    sizes = np.array([len(v or b"") + 1 for v in values], np.int64)
    ends = np.cumsum(sizes)
    return h, np.searchsorted(start, ends, "left")
