"""Document fingerprints by prefix polynomial hashes.

A text's code points c_0, c_1, .. get prefix arrays of sum c_i B^i modulo the
prime 2^31 - 1, for two bases B.  The hash of any span follows from two entries
of each array, so spans of any two texts are compared in constant time, and
the longest common extension from two places is found by binary search.

The fingerprint is a min-hash over the hashes of all spans of ``SPAN`` code
points (a quarter of the text, if that is less): they fall into 64 bins, and
each bin keeps 16 bits of its smallest.  The likeness of two fingerprints is
the share of equal bins, an estimate of the share of spans that two texts have
in common.

Texts of a block share one pair of prefix arrays; a text of many megabytes is
read in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedshade.llm.common import bound_batches, in_blocks, key_of, mix64, utf8
from pedshade.runtime import Scratch

SPAN = 12
BINS = 64
PRIME = np.uint64((1 << 31) - 1)
BASES = (911_382_323, 972_663_749)
#: Bytes of text that a range of doc_ids holds, about.
RANGE_BYTES = 64 << 20
#: Longer texts are read in pieces of this size.
PIECE_BYTES = 2 << 20

_31 = np.uint64(31)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _fold(x: np.ndarray) -> np.ndarray:
    """A number congruent to x; below 2^33 for x below 2^63."""
    return (x & PRIME) + (x >> _31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for any 64-bit x."""
    x = (x & PRIME) + (x >> _31)
    x = (x & PRIME) + (x >> _31)
    return np.where(x >= PRIME, x - PRIME, x)


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    """base^0 .. base^(2^bits - 1), by doubling."""
    p = int(PRIME)
    out = np.ones(1, np.uint64)
    for b in range(bits):
        out = np.concatenate([out, _mod(out * np.uint64(pow(base, 1 << b, p)))])
    return out


class PrefixHashes:
    """Prefix arrays of one text, a uint32 array of code points."""

    def __init__(self, points: np.ndarray):
        n = self.n = len(points)
        bits = max(10, n.bit_length())
        c = points.astype(np.uint64) + np.uint64(1)
        self.prefix, self.inverse = [], []
        for base in BASES:
            terms = _fold(c * _powers(base, bits)[:n])  # below 2^32, so 2^31 of them can be summed
            self.prefix.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))
            self.inverse.append(_powers(pow(base, -1, int(PRIME)), bits))

    def spans(self, first: int, last: int, length: int) -> np.ndarray:
        """62-bit hashes of the spans of ``length`` that start at first .. last - 1."""
        out = np.zeros(max(0, last - first), np.uint64)
        if not len(out):
            return out
        # Sums of up to 2^20 terms fold below 2^32, whose product with a residue fits 64 bits.
        fold = _fold if length < 1 << 20 else _mod
        for s, inv in zip(self.prefix, self.inverse, strict=True):
            d = fold(s[first + length : last + length] - s[first:last])
            out = (out << _31) | _mod(d * inv[first:last])
        return out

    def spans_at(self, first: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """62-bit hashes of spans of any lengths at any places."""
        out = np.zeros(len(first), np.uint64)
        last = first + length
        for s, inv in zip(self.prefix, self.inverse, strict=True):
            out = (out << _31) | _mod(_mod(s[last] - s[first]) * inv[first])
        return out

    def span(self, start: int, length: int) -> int:
        return int(self.spans(start, start + 1, length)[0])


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common extension of a's place i and b's place j."""
    lo, hi = 0, min(a.n - i, b.n - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a.span(i, mid) == b.span(j, mid):
            lo = mid
        else:
            hi = mid - 1
    return lo


def registers(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BINS, _EMPTY)
    h = mix64(hashes)
    np.minimum.at(out, (h & np.uint64(BINS - 1)).astype(np.int64), h >> np.uint64(6))
    return out


def span_of(n: int | np.ndarray):
    """Span length for a text of n code points."""
    return np.maximum(1, np.minimum(SPAN, n // 4))


def _marked(hashes: np.ndarray, length: int) -> np.ndarray:
    """Tells spans of different lengths apart."""
    return hashes + np.uint64(length << 58)


def text_registers(points: np.ndarray) -> np.ndarray:
    n, length = len(points), int(span_of(len(points)))
    if not n:
        return registers(np.zeros(1, np.uint64))
    return registers(_marked(PrefixHashes(points).spans(0, n - length + 1, length), length))


def _bins(regs: np.ndarray) -> np.ndarray:
    return np.where(regs == _EMPTY, 0xFFFF, np.minimum(regs & np.uint64(0xFFFF), np.uint64(0xFFFE))).astype(np.uint16)


def as_string(regs: np.ndarray) -> str:
    """Four hex digits for each bin; ffff is an empty bin."""
    return _bins(regs).astype(">u2").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of bins, row by row."""
    some = (x != 0xFFFF) | (y != 0xFFFF)
    return ((x == y) & some).sum(axis=-1) / np.maximum(1, some.sum(axis=-1))


def code_points(text: bytes | None) -> np.ndarray:
    return np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, place)`` of every place in the runs of ``n`` places from ``first``."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]


def _gather(hashes: PrefixHashes, first: np.ndarray, n: np.ndarray, length: np.ndarray, into: list[np.ndarray], kept: np.ndarray | None = None) -> None:
    """Puts the spans of each text, ``n`` code points from ``first``, into its registers.

    Those that start before ``kept`` go to the first table, the rest to the last.
    """
    for size in np.unique(length[n > 0]).tolist():
        here = np.flatnonzero((length == size) & (n > 0))
        owner, at = _ranges(first[here], n[here] - size + 1)
        owner = here[owner]
        h = mix64(_marked(hashes.spans_at(at, size), size))
        slot = owner * BINS + (h & np.uint64(BINS - 1)).astype(np.int64)
        h >>= np.uint64(6)
        if kept is None:
            np.minimum.at(into[-1].reshape(-1), slot, h)
            continue
        head = at - first[owner] < kept[owner]
        for table, some in zip(into, (head, ~head), strict=True):
            np.minimum.at(table.reshape(-1), slot[some], h[some])


_NONE = registers(np.zeros(1, np.uint64))
_COLUMNS = ("n_chars", "edited_sha256", "bins", "edited_bins", "near_edited", "near_next", "common_prefix")


def _block(texts: list[bytes]) -> dict[str, list | np.ndarray]:
    """The result's columns for all texts but the last, each with the next one."""
    points = [code_points(t) for t in texts]
    n = np.array([len(p) for p in points], np.int64)
    first = np.cumsum(n) - n
    length, k = span_of(n), n // 4
    kept = np.maximum(0, n - k - length + 1)
    hashes = PrefixHashes(np.concatenate(points))
    head, rest = (np.full((len(texts), BINS), _EMPTY) for _ in range(2))
    _gather(hashes, first, n, length, [head, rest], kept)
    bins = _bins(np.where(n[:, None] > 0, np.minimum(head, rest), _NONE))
    # The edited text: spans of the part it keeps are known, the others come from its tail.
    m = len(texts) - 1
    n0, k0 = n[:m], k[:m]
    taken = np.minimum(k0, n[1:])
    edited_n = n0 - k0 + taken
    edited_length = span_of(edited_n)
    same = edited_length == length[:m]
    begin = np.where(same, kept[:m], 0)
    tails = [p for i in range(m) for p in (points[i][begin[i] : n0[i] - k0[i]], points[i + 1][: taken[i]])]
    tail_n = edited_n - begin
    edited = np.full((m, BINS), _EMPTY)
    _gather(PrefixHashes(np.concatenate([np.zeros(0, np.uint32), *tails])), np.cumsum(tail_n) - tail_n, tail_n, edited_length, [edited])
    edited = np.where(same[:, None], np.minimum(edited, head[:m]), edited)
    edited_bins = _bins(np.where(edited_n[:, None] > 0, edited, _NONE))
    # The longest common extension of what was replaced and what replaced it.
    lo, hi, a, b = np.zeros(m, np.int64), taken.copy(), first[:m] + n0 - k0, first[1:]
    while len(going := np.flatnonzero(lo < hi)):
        mid = (lo[going] + hi[going] + 1) // 2
        equal = hashes.spans_at(a[going], mid) == hashes.spans_at(b[going], mid)
        lo[going] = np.where(equal, mid, lo[going])
        hi[going] = np.where(equal, hi[going], mid - 1)
    sha = [hashlib.sha256(texts[i][: _offset(texts[i], n0[i] - k0[i], n0[i])] + texts[i + 1][: _offset(texts[i + 1], taken[i], n[i + 1])]).hexdigest() for i in range(m)]
    return dict(zip(_COLUMNS, (n0, sha, bins[:m], edited_bins, likeness(bins[:m], edited_bins), likeness(bins[:m], bins[1:]), n0 - k0 + lo), strict=True))


# -- long texts ----------------------------------------------------------------------------

def _pieces(raw: bytes) -> Iterator[bytes]:
    """Pieces of UTF-8 bytes, no character cut."""
    at = 0
    while at < len(raw):
        end = at + PIECE_BYTES
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        yield raw[at:end]
        at = end


def _leads(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80


def _length(raw: bytes) -> int:
    return sum(int(_leads(p).sum()) for p in _pieces(raw))


def _offset(raw: bytes, k: int, n: int) -> int:
    """The byte where code point k of n starts."""
    if k >= n:
        return len(raw)
    if len(raw) == n:
        return int(k)
    at = 0
    for p in _pieces(raw):
        leads = np.flatnonzero(_leads(p))
        if k < len(leads):
            return at + int(leads[k])
        k -= len(leads)
        at += len(p)
    return at


def _long_registers(raw: bytes, length: int) -> np.ndarray:
    """Registers of all spans, a piece at a time with what spans from the piece before need."""
    out, before = np.full(BINS, _EMPTY), np.zeros(0, np.uint32)
    for p in _pieces(raw):
        points = np.concatenate([before, code_points(p)])
        out = np.minimum(out, registers(_marked(PrefixHashes(points).spans(0, len(points) - length + 1, length), length)))
        before = points[max(0, len(points) - length + 1) :]
    return out


def _long_extension(a: bytes, b: bytes) -> int:
    """Code points of the longest common prefix."""
    seen = 0
    for p in _pieces(a):
        other, b = b[: len(p)], b[len(p) :]
        if other != p:
            return seen + common_extension(*(x for raw in (p, other) for x in (PrefixHashes(code_points(raw)), 0)))
        seen += int(_leads(p).sum())
    return seen


def _long_pair(text: bytes, after: bytes) -> dict[str, list | np.ndarray]:
    """The result of :func:`_block` for one text and the next, in bounded memory beside the bytes."""
    n, following = _length(text), _length(after)
    k, length = n // 4, int(span_of(n))
    taken = min(k, following)
    m, cut, end = n - k + taken, _offset(text, n - k, n), _offset(after, taken, following)
    kept, edited_length = max(0, n - k - length + 1), int(span_of(m))
    regs = _long_registers(text, length) if n else _NONE
    if edited_length == length and kept:
        head = _long_registers(text[: _offset(text, kept + length - 1, n)], length)
        edited = np.minimum(head, _long_registers(text[_offset(text, kept, n) : cut] + after[:end], length))
    else:
        edited = _long_registers(text[:cut] + after[:end], edited_length) if m else _NONE
    next_bins = _bins(_long_registers(after, int(span_of(following))) if following else _NONE)
    sha = hashlib.sha256(text[:cut])
    sha.update(after[:end])
    bins, edited_bins = _bins(regs), _bins(edited)
    values = ([n], [sha.hexdigest()], bins[None], edited_bins[None], [float(likeness(bins, edited_bins))], [float(likeness(bins, next_bins))], [n - k + _long_extension(text[cut:], after[:end])])
    return dict(zip(_COLUMNS, values, strict=True))


# -- tables --------------------------------------------------------------------------------

_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, bins binary, edited_bins binary, near_edited double, near_next double, common_prefix long"
_PLACED = "part int, place int, " + _SCHEMA + ", text binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}


def _batch(schema: str, n: int, columns: dict) -> pa.RecordBatch:
    """A batch of ``n`` rows; columns that are not given are null."""
    fields = [f.split() for f in schema.split(", ")]
    arrays = []
    for name, kind in fields:
        values = columns.get(name)
        if name.endswith("bins") and values is not None:
            values = [row.astype(">u2").tobytes() for row in values]
        arrays.append(pa.nulls(n, _KINDS[kind]) if values is None else pa.array(values, _KINDS[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=[f for f, _ in fields])


def _valid(text: bytes | None) -> bytes:
    """UTF-8, whatever came in."""
    text = text or b""
    try:
        for p in _pieces(text):
            p.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each text with the one after it within a range; the range's first and last text come along for its neighbours."""
    held: list[tuple] = []
    part = 0
    for rows, values in in_blocks(batches, "text"):
        ids = rows.column(1).to_pylist()
        if not held:
            part = rows.column(0)[0].as_py()
            yield _batch(_PLACED, 1, {"part": [part], "place": [1], "text": [_valid(values[0])]})
        held += [(i, _valid(v)) for i, v in zip(ids, values, strict=True)]
        runs = [held] if max(len(t) for _, t in held) <= PIECE_BYTES else list(zip(held[:-1], held[1:], strict=True))
        for run in runs:
            if len(run) > 1:
                texts = [t for _, t in run]
                made = _block(texts) if max(map(len, texts)) <= PIECE_BYTES else _long_pair(*texts)
                n = len(run) - 1
                yield _batch(_PLACED, n, {"part": [part] * n, "place": [0] * n, "doc_id": [i for i, _ in run[:-1]], **made})
        held = held[-1:]
    for i, text in held:
        yield _batch(_PLACED, 1, {"part": [part], "place": [2], "doc_id": [i], "text": [text]})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for a range's last text and the first of the next range."""
    for batch in batches:
        for i, text, after in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            made = _block([text, after]) if max(len(text), len(after)) <= PIECE_BYTES else _long_pair(text, after)
            yield _batch(_SCHEMA, 1, {"doc_id": [i], **made})


def document_fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    Needs columns doc_id and text; others are ignored.  The edited text has
    the last quarter of the code points replaced by the first as many of the
    next document in ascending doc_id, after the last the first.
    ``common_prefix`` is the length of the longest common prefix of both.
    Null texts count as empty, a null doc_id comes before all others, rows that
    share a doc_id are ordered by their texts' hashes, equal rows follow each
    other, a lone row is its own next; repeated rows come out repeated; an empty
    table gives an empty one.

    Rows are dealt by ranges of that order, so rows of one doc_id, or copies of
    one row, spread over ranges as others do.  A range is walked by one task,
    which holds a block of texts at a time; its last text meets the first of the
    next range in a join.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprint")
    order = ["key", "same", "nth"]
    rows = bound_batches(docs).select(
        key_of().alias("key"), F.xxhash64("text").alias("same"), F.monotonically_increasing_id().alias("nth"), F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    made = scratch.write(dealt.mapInArrow(_walk, _PLACED))
    firsts, lasts = made.filter("place = 1").select("part", F.col("text").alias("after")), made.filter("place = 2").select("part", "doc_id", "text")
    # A row for each range: its number and the next one's, the first's after the last.
    every = Window.partitionBy(F.lit(0))
    following = made.filter("place = 1").select("part", F.coalesce(F.lead("part").over(every.orderBy("part")), F.min("part").over(every)).alias("next"))
    seams = lasts.join(following, "part").drop("part").join(firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "after")
    whole = made.filter("place = 0").select(*[c.split()[0] for c in _SCHEMA.split(", ")]).unionByName(seams.mapInArrow(_finish, _SCHEMA))
    text = lambda c: F.lower(F.hex(c))
    return whole.select(
        "doc_id", "n_chars", "edited_sha256", text("bins").alias("fingerprint"), text("edited_bins").alias("edited_fingerprint"), "near_edited", "near_next", "common_prefix"
    )
