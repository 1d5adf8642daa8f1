"""Exact removal of repeated 100-byte strings by suffix arrays over shards.

Windows of ``WINDOW`` bytes are routed by content: each is owned by the
smallest hash among its ``GRAM``-byte grams (the leftmost of equal ones), so
equal windows have equal owners, and all windows that one gram owns in a
document lie in one short context.  Contexts that are equal throughout need
only their earliest place.  What remains, different contexts of one gram, goes
to shards, whose suffix arrays are built by induced sorting; the permuted
common prefixes tell which windows are equal, and in each set of equal windows
all but the earliest are removed.

Contexts of a gram that has more than ``PIECE`` of them are cut into bands of
``BAND`` places of the gram within the window.  All windows of a band hold the
same 85 bytes around the gram, their core, and go to shards by its hash.  A
core that is still shared by more than ``PIECE`` is dealt over several shards,
before its rows move where it holds over a thousandth of them; the windows that
come out earliest there are compared across those shards by two 64-bit hashes
of their bytes, so that no match is lost.

Texts are shuffled once, by document, for both the contexts' bytes and the
final digests.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedshade.llm.common import bound_batches, bounds, in_blocks, key_of, load64, mix64, utf8
from pedshade.llm.sharding import ranked
from pedshade.llm.suffix import permuted_lcp, suffix_array
from pedshade.runtime import Scratch

WINDOW = 100
GRAM = 24
#: Rows of one gram or core that one shard takes.
PIECE = 8_000
BAND = 16
#: Bytes of contexts that one suffix array spans, and of text that is cut into contexts at once, about.
SHARD_BYTES, TEXT_BYTES = 384 << 10, 768 << 10
PARTITION_BYTES = 48 << 20

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def owners(buf: np.ndarray, valid: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a buffer: (gram hash, gram's place, first and last window start).

    ``valid`` marks the places where a window may start.  The buffer needs
    ``window`` + 8 spare bytes behind the last of them.
    """
    loads = load64(buf)
    n = len(loads) - 16
    h = mix64(loads[:n] * _M[0] + loads[8 : n + 8] * _M[1] + loads[16 : n + 16] * _M[2])
    low = np.uint64((1 << 24) - 1)
    best = (h & ~low) | np.arange(n, dtype=np.uint64)
    grams, width = window - GRAM + 1, 1
    while 2 * width <= grams:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < grams:
        best = np.minimum(best[: len(best) - (grams - width)], best[grams - width :])
    start = np.flatnonzero(valid[: len(best)])
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    at = (best[start] & low).astype(np.int64)
    cut = np.flatnonzero((at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]])
    return h[at[lo]].view(np.int64), at[lo], start[lo], start[hi - 1]


def merged(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans [a, b) of each key, touching ones joined, in order."""
    if not len(key):
        return key, a, b
    order = np.lexsort((a, key))
    key, a, b = key[order], a[order], b[order]
    rank = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) * (np.int64(1) << 40)
    reach = np.maximum.accumulate(rank + b)
    new = np.concatenate([[True], rank[1:] + a[1:] > reach[:-1]])
    start = np.flatnonzero(new)
    ends = np.maximum.reduceat(b, start)
    return key[start], a[start], ends


def _later(new: np.ndarray, key: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Rows of a run that stand at another place than the run's first, which ``new`` marks."""
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (key != key[lead]) | (a != a[lead])


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 1 << 20):
    """Lists of (key, offset, bytes); a text beyond ``most`` comes in pieces that share no window start."""
    for rows, values in in_blocks(batches, "text", TEXT_BYTES):
        keys = rows.column(0).to_pylist()
        small = [(k, 0, v) for k, v in zip(keys, values, strict=True) if v and WINDOW <= len(v) <= most]
        if small:
            yield small
        for k, v in zip(keys, values, strict=True):
            for lo in range(0, len(v) - WINDOW + 1 if v and len(v) > most else 0, most):
                yield [(k, lo, v[lo : lo + most + WINDOW - 1])]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (route, kind, same, key, a, b, p).

    kind 0: a context's earliest place in its block; a and b are its first and
    last window start, p the gram's place from a, same the hash of its bytes
    and p.  kind 1: a removed span [a, b), found within the block.
    """
    for pieces in _pieces(batches):
        sizes = np.array([len(t) for *_, t in pieces], np.int64)
        base = np.cumsum(sizes) - sizes
        raw = b"".join(t for *_, t in pieces) + bytes(WINDOW + 16)
        buf = np.frombuffer(raw, np.uint8)
        valid = np.zeros(len(buf), bool)
        for s, n in zip(base, sizes, strict=True):
            valid[s : s + n - WINDOW + 1] = True
        gram, at, first, last = owners(buf, valid)
        if not len(gram):
            continue
        h = xxhash.xxh3_64_intdigest
        same = np.array(
            [h(raw[s:e], p) for s, e, p in zip(first.tolist(), (last + WINDOW).tolist(), (at - first).tolist(), strict=True)], np.uint64
        ).view(np.int64)
        own = np.searchsorted(base, first, "right") - 1
        key = np.array([k for k, *_ in pieces], np.int64)[own]
        shift = np.array([o for _, o, _ in pieces], np.int64)[own] - base[own]
        place, first, last = at - first, first + shift, last + shift
        order = np.lexsort((first, key, same, gram))
        gram, same, key, first, last, place = (x[order] for x in (gram, same, key, first, last, place))
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (same[1:] != same[:-1])])
        again = _later(new, key, first)
        k, a, b = merged(key[again], first[again], last[again] + WINDOW)
        n = np.array([new.sum(), len(k)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([gram[new], mix64(k.view(np.uint64) + np.uint64(1)).view(np.int64)])),
                pa.array(np.repeat(np.array([0, 1], np.int8), n)),
                pa.array(np.concatenate([same[new], np.zeros(len(k), np.int64)])),
                pa.array(np.concatenate([key[new], k])),
                pa.array(np.concatenate([first[new], a])),
                pa.array(np.concatenate([last[new], b])),
                pa.array(np.concatenate([place[new], np.zeros(len(k), np.int64)]).astype(np.int32)),
            ],
            names=["route", "kind", "same", "key", "a", "b", "p"],
        )


def _in_pieces(parts: Iterator[pd.DataFrame], by: str, piece: int):
    """Frames of whole groups of ``by``, with False; groups beyond ``piece`` rows in frames of their own, with True."""
    held: pd.DataFrame | None = None
    hot = None
    for pdf in parts:
        held = pdf if held is None or not len(held) else pd.concat([held, pdf], ignore_index=True)
        while len(held):
            key = held[by].values
            if hot is not None:
                n = int(np.searchsorted(key, hot, "right"))
                while n >= piece:
                    yield held.iloc[:piece], True
                    held, n = held.iloc[piece:], n - piece
                if n == len(held):
                    break
                if n:
                    yield held.iloc[:n], True
                held, hot = held.iloc[n:], None
                continue
            cut = bounds(key)
            big = np.flatnonzero(np.diff(cut) >= piece)
            to = int(cut[big[0]]) if len(big) else int(cut[-2])
            if to:
                yield held.iloc[:to], False
                held = held.iloc[to:]
            if not len(big):
                break
            hot = key[to]
    if held is not None and len(held):
        yield held, hot is not None


def _sift(parts: Iterator[pd.DataFrame], piece: int) -> Iterator[pd.DataFrame]:
    """Rows (unit, hot, kind, key, a, b, p): kind 0 contexts for the suffix arrays, kind 1 removed spans.

    Input is sorted by route, kind, same, key, a.  Of equal contexts the first
    is the earliest; the windows of the others are removed.
    """
    earlier: tuple[int, ...] | None = None  # the context that a hot group's last frame ended in, and its first place
    for pdf, hot in _in_pieces(parts, "route", piece):
        kind, route, same = pdf.kind.values, pdf.route.values, pdf.same.values
        key, a, b = pdf.key.values, pdf.a.values, pdf.b.values
        context = kind == 0
        new = np.ones(len(pdf), bool)
        new[1:] = (route[1:] != route[:-1]) | (same[1:] != same[:-1]) | (kind[1:] != kind[:-1])
        later = context & _later(new, key, a)
        first = new & context
        if hot and earlier is not None and earlier[:2] == (route[0], same[0]) and context[0]:
            n = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(new)  # the run goes on from the last frame
            first[0], later[:n] = False, (key[:n] != earlier[2]) | (a[:n] != earlier[3])
        if context[-1]:
            last = int(np.flatnonzero(new)[-1])
            if first[last] or earlier is None or earlier[:2] != (route[-1], same[-1]):
                earlier = (route[-1], same[-1], key[last], a[last])
        else:
            earlier = None
        # A gram with one context only has no other window to compare.
        cut = bounds(route)
        several = np.repeat(np.add.reduceat(first.astype(np.int64), cut[:-1]) > 1, np.diff(cut))
        send = first & (several | hot)
        k, s, e = merged(
            np.concatenate([key[later], key[~context]]),
            np.concatenate([a[later], a[~context]]),
            np.concatenate([b[later] + WINDOW, b[~context]]),
        )
        n = np.array([send.sum(), len(k)])
        yield pd.DataFrame(
            {
                "unit": np.concatenate([route[send], k]),
                "hot": np.repeat([hot, False], n),
                "kind": np.repeat(np.array([0, 1], np.int8), n),
                "key": np.concatenate([key[send], k]),
                "a": np.concatenate([a[send], s]),
                "b": np.concatenate([b[send], e]),
                "p": np.concatenate([pdf.p.values[send], np.zeros(len(k), np.int32)]),
            }
        )


def bands(a: int, b: int, gram: int):
    """``(number, first start, last start, core's start, core's end)`` of the bands of a context.

    A band holds the window starts whose distance to the gram has the same
    quotient by ``BAND``, so the core depends on the windows' bytes alone.
    """
    for n in range((gram - b) // BAND, (gram - a) // BAND + 1):
        near, far = n * BAND, n * BAND + BAND - 1
        yield n, max(a, gram - far), min(b, gram - near), gram - near, gram - far + WINDOW


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each document's contexts, those of hot grams by bands."""
    h = xxhash.xxh3_64_intdigest
    for rows, values in in_blocks(batches, "text"):
        out: list[tuple] = []
        for key, contexts, v in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), values, strict=True):
            for c in contexts:
                a, b = c["a"], c["b"]
                if v is None or b + WINDOW > len(v):
                    continue
                if not c["hot"]:
                    out.append((c["unit"], key, a, v[a : b + WINDOW]))
                    continue
                for n, lo, hi, s, e in bands(a, b, a + c["p"]):
                    out.append((h(v[s:e], n) - (1 << 63), key, lo, v[lo : hi + WINDOW]))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["unit", "key", "a", "text"])


def _count_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows :func:`_cut_out` makes of each core."""
    h = xxhash.xxh3_64_intdigest
    for rows, values in in_blocks(batches, "text"):
        held: Counter[int] = Counter()
        for contexts, v in zip(rows.column(1).to_pylist(), values, strict=True):
            for c in contexts:
                if c["hot"] and v is not None and c["b"] + WINDOW <= len(v):
                    held.update(h(v[s:e], n) - (1 << 63) for n, _, _, s, e in bands(c["a"], c["b"], c["a"] + c["p"]))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["unit", "n"])


def window_hashes(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows at the given places; ``text`` needs 8 spare bytes."""
    loads = load64(text)
    x, y = np.zeros(len(at), np.uint64), np.full(len(at), _M[2])
    for o in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        w = loads[at + o]
        x, y = mix64(x * _M[0] + w), mix64(y * _M[1] ^ w)
    return x.view(np.int64), y.view(np.int64)


def _sort_shard(pdf: pd.DataFrame, hot: bool) -> pd.DataFrame:
    """Removed spans (kind 1) of a shard's contexts; for a part of a larger unit the windows that are earliest here too (kind 2)."""
    pdf = pdf.sort_values(["key", "a"], kind="stable")
    key, a = pdf.key.values, pdf.a.values
    code, texts = pd.factorize(pdf.text)  # equal contexts: the earliest one stands for all
    size = np.array([len(t) for t in texts], np.int64)
    lead = np.flatnonzero(np.concatenate([[True], code[1:] > np.maximum.accumulate(code)[:-1]]))
    again = np.flatnonzero((key != key[lead][code]) | (a != a[lead][code]))
    spans = [(key[again], a[again], a[again] + size[code[again]])]
    key, a = key[lead], a[lead]
    base = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(b"\xff".join(texts) + b"\xff" + bytes(8), np.uint8)  # no UTF-8 text holds 0xff
    n = len(text) - 8
    windows = size - WINDOW + 1
    starts = np.repeat(base, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    gone = np.zeros(n + 1, bool)
    if len(texts) > 1:
        t = np.empty(n + 1, np.uint16)
        t[:n] = text[:n]
        t[:n] += 1
        t[n] = 0
        sa = suffix_array(t)
        lcp = permuted_lcp(text[:n], sa)
        may = np.zeros(n + 1, bool)
        may[starts] = True
        run = np.zeros(n + 1, np.int64)  # number of each suffix's set of equal windows, in suffix order
        run[1:] = np.cumsum(lcp[sa[1:]] < WINDOW)
        keep = may[sa]
        place, group = sa[keep], run[keep]
        # Contexts stand in (key, start) order, so the least place is the earliest.
        cut = bounds(group)
        least = np.repeat(np.minimum.reduceat(place, cut[:-1]), np.diff(cut))
        mine, its = np.searchsorted(base, place, "right") - 1, np.searchsorted(base, least, "right") - 1
        gone[place] = (key[mine] != key[its]) | (a[mine] + place - base[mine] != a[its] + least - base[its])
    at = np.flatnonzero(gone)
    own = np.searchsorted(base, at, "right") - 1
    spans.append((key[own], a[own] + at - base[own], a[own] + at - base[own] + WINDOW))
    k, s, e = merged(*(np.concatenate(x) for x in zip(*spans, strict=True)))
    out = [pd.DataFrame({"kind": np.int8(1), "h1": mix64(k.view(np.uint64) ^ s.astype(np.uint64)).view(np.int64), "h2": s, "key": k, "a": s, "b": e})]
    if hot:
        at = starts[~gone[starts]]
        own = np.searchsorted(base, at, "right") - 1
        h1, h2 = window_hashes(text, at)
        p = a[own] + at - base[own]
        out.append(pd.DataFrame({"kind": np.int8(2), "h1": h1, "h2": h2, "key": key[own], "a": p, "b": p + WINDOW}))
    return pd.concat(out, ignore_index=True)


def _sort_shards(parts: Iterator[pd.DataFrame], piece: int) -> Iterator[pd.DataFrame]:
    for pdf, hot in _in_pieces(parts, "unit", piece):
        # Units in stretches of about a shard each; a unit is never cut here.
        size = np.cumsum([len(x) for x in pdf.text])
        cut = bounds(pdf.unit.values)
        # A unit of one context has nothing to compare, but a part of a dealt one may have elsewhere.
        lo = 0
        for hi in cut[1:].tolist():
            if hi == len(pdf) or size[hi - 1] - (size[lo - 1] if lo else 0) >= SHARD_BYTES:
                part = pdf.iloc[lo:hi]
                dealt = part.dealt.values | hot
                whole = part[~dealt]
                for some, split in ((whole[whole.duplicated("unit", keep=False)], False), (part[dealt], True)):
                    if len(some):
                        yield _sort_shard(some, split)
                lo = hi


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64()] * 4 + [pa.string()]
    for rows, values in in_blocks(batches, "text"):
        out = []
        for doc_id, spans, v in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), values, strict=True):
            kept, removed, n = removed_from(v or b"", spans or [])
            out.append((doc_id, len(v or b""), removed, n, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def removed_from(text: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left of a text without the spans, the bytes removed, and the runs they form."""
    kept, at, n = [], 0, 0
    removed = 0
    reach = -1
    for a, b in sorted((s["a"], min(s["b"], len(text))) for s in spans):
        if a >= b:
            continue
        if a > reach:
            n += 1
        kept.append(text[at : max(a, at)])
        removed += max(0, b - max(a, at))
        at, reach = max(at, b), max(reach, b)
    return b"".join([*kept, text[at:]]), removed, n


def placed(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, text)``: ``key`` is a number for each distinct document, in their order.

    It is the doc_id itself where no two texts share one.  Otherwise documents
    of one doc_id, or of none, go by their texts' hashes and all are numbered.
    """
    rows = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), key_of().alias("key"), F.xxhash64("text").alias("same"), utf8().alias("text"))
    ids = docs.select(key_of().alias("key"), F.xxhash64("text").alias("same"))
    shared = ids.groupBy("key").agg(F.min("same").alias("a"), F.max("same").alias("b")).filter("a <> b")
    if shared.isEmpty():
        return rows.drop("same")
    order, _ = ranked(ids.distinct(), F.lit(0), [F.col("key"), F.col("same")], Scratch(docs.sparkSession, "places"))
    return rows.join(order.select("key", "same", "_rank"), ["key", "same"]).select("doc_id", F.col("_rank").alias("key"), "text")


def cut_contexts(docs: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(texts, sifted, contexts)``: texts (doc_id, key, text) dealt by key, what :func:`_sift` found, and the contexts' bytes by unit."""
    spark = docs.sparkSession
    rows = placed(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Partitions of the texts hold about so many bytes, whatever the session's setting.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    order = ["route", "kind", "same", "key", "a"]
    sifted = Scratch(spark, "substrings").write(
        rows.select("key", "text").mapInArrow(_contexts, "route long, kind byte, same long, key long, a long, b long, p int")
        .repartition("route")
        .sortWithinPartitions(*order)
        .mapInPandas(lambda parts: _sift(parts, piece), "unit long, hot boolean, kind byte, key long, a long, b long, p int")
    )
    texts = rows.repartition(n, "key")
    wanted = (
        sifted.filter("kind = 0").groupBy("key").agg(F.collect_list(F.struct("unit", "hot", "a", "b", "p")).alias("contexts")).hint("shuffle_hash")
    )
    held = texts.join(wanted, "key").select("key", "contexts", "text", "doc_id")  # doc_id only so that all uses of the texts share one shuffle
    # Rows of hot grams' bands, the ones that cores can gather; from the contexts alone.
    of_bands = F.sum(F.floor(F.col("p") / BAND) - F.floor((F.col("p") + F.col("a") - F.col("b")) / BAND) + 1)
    banded = sifted.filter("kind = 0 and hot").agg(F.coalesce(of_bands, F.lit(0))).first()[0]
    rows_out = held.mapInArrow(_cut_out, "unit long, key long, a long, text binary")
    if banded > piece:
        counts = held.filter(F.exists("contexts", lambda c: c["hot"])).mapInArrow(_count_cores, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n"))
        # Over a thousandth of the rows each, so at most a thousand cores.
        hot = counts.filter((F.col("n") > piece) & (F.col("n") * 1000 > banded)).select("unit", F.ceil(F.col("n") / piece).alias("parts"))
        dealt = rows_out.join(F.broadcast(hot), "unit", "left")
        own = F.xxhash64("unit", F.pmod(F.xxhash64("key", "a"), F.col("parts")))
        rows_out = dealt.select(F.when(F.col("parts").isNull(), F.col("unit")).otherwise(own).alias("unit"), "key", "a", "text", F.col("parts").isNotNull().alias("dealt"))
    else:
        rows_out = rows_out.withColumn("dealt", F.lit(False))
    return texts, sifted, rows_out


def removed_spans(docs: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """``(texts, spans)``: texts (doc_id, key, text) dealt by key, and spans (key, a, b) to remove, which may overlap."""
    texts, sifted, contexts = cut_contexts(docs, piece)
    shards = (
        contexts.repartition("unit")
        .sortWithinPartitions("unit")
        .mapInPandas(lambda parts: _sort_shards(parts, piece), "kind byte, h1 long, h2 long, key long, a long, b long")
    )
    # Equal windows of a core dealt over several shards; equal places share a rank.
    nth = F.rank().over(Window.partitionBy("h1", "h2", "kind").orderBy("key", "a"))
    found = shards.withColumn("nth", nth).filter("kind = 1 or nth > 1").select("key", "a", "b")
    return texts, sifted.filter("kind = 1").select("key", "a", "b").unionByName(found)


def dedup_substrings(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs``.

    Needs columns doc_id and text; others are ignored.  A byte goes if a
    100-byte string over it also starts earlier, in a document with a smaller
    doc_id or before in the same one.  Null text counts as empty; a null doc_id
    comes first.  Rows of one doc_id and text are one place in that order: they
    don't remove each other, and what is removed from one is removed from the
    same bytes of the others.  Different texts of one doc_id, or of none, go by
    their hashes and do remove from each other.  Every row comes out; an empty
    table gives an empty one.
    """
    texts, spans = removed_spans(docs, piece)
    by_doc = spans.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans")).hint("shuffle_hash")
    return (
        texts.join(by_doc, "key", "left")
        .select("doc_id", "spans", "text")
        .mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
