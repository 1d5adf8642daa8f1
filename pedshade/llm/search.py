"""Ranked lexical search: term-at-a-time over short lists, document-at-a-time over long ones.

One pass over the texts keeps, of each document, its length and how often it
holds the terms that are asked for.  Runs of documents are then inverted in
their tasks.  Of an item's lists the short ones are summed into accumulators,
and these take part, as one more list with bounds of its own, in a walk over
the long lists in document order: windows of documents whose bounds cannot
reach the k-th score so far are skipped, and in the others the lists with the
least bounds are only probed for documents that can still reach it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedshade.llm.common import NULL_ID, bound_batches, bounds, in_blocks, key_of, utf8, word_hashes
from pedshade.runtime import Scratch

TOP = 10
#: Terms of items that one pass over the documents answers, about; more items take more passes.
PASS_TERMS = 200_000
#: An item's short lists have together at most a run's documents divided by this.
SHORT_PART = 8
#: Documents of a run, its postings (about), and documents of a window.
RUN_DOCS, RUN_POSTINGS, WINDOW = 1 << 15, 2_000_000, 1 << 10

_INDEX = "doc_id long, n long, terms binary, tfs binary"
_FOUND = "item_id long, doc_id long, score long"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, values in in_blocks(batches, "text"):
        hashes, ends = word_hashes(values)
        row = np.repeat(np.arange(len(values)), np.diff(ends, prepend=0))
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(hashes.view(np.int64))], names=["item_id", "term"])


def _index(vocabulary: np.ndarray):
    """Length of each document, and the numbers and counts of the vocabulary's terms in it."""
    known = vocabulary if len(vocabulary) else np.zeros(1, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, values in in_blocks(batches, "text"):
            hashes, ends = word_hashes(values)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.flatnonzero(known[at] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
            pairs, tfs = np.unique(np.searchsorted(ends, hit, "right") * len(known) + at[hit], return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(1, len(values)) * len(known))
            terms = [t.tobytes() for t in np.split((pairs % len(known)).astype(np.int32), cuts)]
            counts = [t.tobytes() for t in np.split(tfs.astype(np.int32), cuts)]
            lengths = pa.array(np.diff(ends, prepend=0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column(0), lengths, pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, df = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df.astype(np.int64))], names=["term", "df"])


class Postings:
    """A list over a run: documents in order, impacts, and the greatest impact in each window."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        self.docs, self.impacts = docs, impacts

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each of ``n`` windows starts in the list, with the end as last entry, and their bounds."""
        edges = np.searchsorted(self.docs, np.arange(n + 1) * WINDOW)
        most = np.zeros(n, np.int64)
        some = np.flatnonzero(edges[1:] > edges[:-1])
        if len(some):
            most[some] = np.maximum.reduceat(self.impacts, edges[some])
        return edges, most


def accumulate(lists: list[Postings]) -> Postings:
    """Term at a time: the sum of the lists."""
    docs = np.concatenate([p.docs for p in lists])
    order = np.argsort(docs, kind="stable")
    cut = bounds(docs[order])[:-1]
    return Postings(docs[order][cut], np.add.reduceat(np.concatenate([p.impacts for p in lists])[order], cut))


class Best:
    """The ``k`` highest scores so far; equal scores go by ascending document."""

    def __init__(self, k: int):
        self.k = k
        self.docs, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below it is out."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.concatenate([self.docs, docs]), np.concatenate([self.scores, scores])
        order = np.lexsort((docs, -scores))[: self.k]
        self.docs, self.scores = docs[order], scores[order]


def walk(lists: list[Postings], ids: np.ndarray, best: Best) -> int:
    """Document at a time over a run, window by window; returns the windows that were read."""
    n = -(-len(ids) // WINDOW)
    edges, most = (np.array(a) for a in zip(*(p.windows(n) for p in lists), strict=True))
    total = most.sum(axis=0)
    scores = np.zeros(WINDOW, np.int64)
    read = 0
    for w in range(n):
        if total[w] < best.least:
            continue
        read += 1
        order = np.argsort(-most[:, w], kind="stable")
        rest = np.append(np.cumsum(most[order, w][::-1])[::-1], 0)  # what lists from here on can add
        inside = int(np.count_nonzero(rest[:-1] >= best.least))  # a document that is only in later lists is out
        scores[:] = 0
        slices = [(lists[i], *edges[i, w : w + 2]) for i in order]
        for p, lo, hi in slices[:inside]:
            scores[p.docs[lo:hi] - w * WINDOW] += p.impacts[lo:hi]
        some = np.flatnonzero((scores > 0) & (scores + rest[inside] >= best.least))
        for (p, lo, hi), later in zip(slices[inside:], rest[inside + 1 :], strict=True):
            if not len(some):
                break
            if hi > lo:
                docs = p.docs[lo:hi]
                at = np.minimum(np.searchsorted(docs, some + w * WINDOW), hi - lo - 1)
                hit = docs[at] == some + w * WINDOW
                scores[some[hit]] += p.impacts[lo:hi][at[hit]]
            some = some[scores[some] + later >= best.least]
        if len(some):
            best.add(ids[w * WINDOW + some], scores[some])
    return read


def impacts_of(tfs: np.ndarray, lengths: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting adds: its term's weight, times a share that falls with its document's length."""
    if len(lengths) and 90 * int(lengths.max()) * n_docs >= 2**63:
        m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    else:
        m = 10 + 90 * lengths * n_docs // n_terms
    return weights * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))


class Run:
    """Consecutive documents, inverted."""

    def __init__(self, ids, lengths, terms, tfs, sizes, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        self.doc, self.term = doc[order], terms[order]
        self.impact = impacts_of(tfs[order].astype(np.int64), lengths[self.doc], weights[self.term], n_docs, n_terms)
        self.cut = np.searchsorted(self.term, np.arange(len(weights) + 1))

    def search(self, terms: np.ndarray, best: Best) -> None:
        sizes = self.cut[terms + 1] - self.cut[terms]
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        lists = [Postings(self.doc[a:b], self.impact[a:b]) for a, b in zip(self.cut[terms[order]], self.cut[terms[order] + 1], strict=True)]
        short = int(np.count_nonzero(np.cumsum(sizes[order]) * SHORT_PART <= len(self.ids)))
        if short > 1:
            lists = [accumulate(lists[:short]), *lists[short:]]
        if lists:
            walk(lists, self.ids, best)


def _runs(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Run]:
    held: list[tuple] = []
    docs = postings = 0

    def invert() -> Run:
        ids, lengths, terms, tfs, sizes = (np.concatenate(c) for c in zip(*held, strict=True))
        return Run(ids, lengths, terms, tfs, sizes, weights, n_docs, n_terms)

    for batch in batches:
        for at in range(0, batch.num_rows, WINDOW):
            part = batch.slice(at, WINDOW)
            ids, lengths = (part.column(i).to_numpy() for i in (0, 1))
            raw = part.column(2).to_pylist()
            terms = np.frombuffer(b"".join(raw), np.int32)
            held.append((ids, lengths, terms, np.frombuffer(b"".join(part.column(3).to_pylist()), np.int32), np.array([len(r) // 4 for r in raw])))
            docs, postings = docs + len(ids), postings + len(terms)
            if docs + WINDOW > RUN_DOCS or postings > RUN_POSTINGS:
                yield invert()
                held, docs, postings = [], 0, 0
    if docs:
        yield invert()


def _search(items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for part in _runs(batches, weights, n_docs, n_terms):
            for (_, terms), b in zip(items, best, strict=True):
                part.search(terms, b)
        for (item, _), b in zip(items, best, strict=True):
            if len(b.docs):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(b.docs), pa.int64()), pa.array(b.docs), pa.array(b.scores)], names=["item_id", "doc_id", "score"])

    return run


def weight_of(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest scores above 0 of each item, over all rows of ``docs``.

    ``docs`` needs columns doc_id and text, ``items`` item_id and text; others
    are ignored.  Terms are runs of ASCII letters, digits and non-ASCII
    characters, lower-cased in A-Z only, and told apart by 64-bit hashes.  Null
    texts have no terms; rows of one item_id, null included, are one item with
    the terms of all; repeated documents are ranked each; equal scores go by
    ascending doc_id, null first.  Where either table is empty, so is the result.
    A pass over the documents answers items of about ``pass_terms`` terms in
    all; its items and their terms' weights are held by every task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), utf8().alias("text")).mapInArrow(_terms, "item_id long, term long")
    asked = scratch.write(asked.distinct())
    passes = -(-asked.count() // pass_terms)
    found = []
    for i in range(passes):
        chosen = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).toPandas()
        vocabulary = np.unique(chosen.term.to_numpy(np.int64).view(np.uint64))
        index = scratch.write(bound_batches(docs).select(key_of().alias("doc_id"), utf8().alias("text")).mapInArrow(_index(vocabulary), _INDEX))
        n_docs, n_terms = index.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        counted = index.select("terms").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
        weights = np.zeros(len(vocabulary), np.int64)
        weights[counted.term.to_numpy(np.int64)] = [weight_of(int(df), n_docs) for df in counted.df]
        chosen["term"] = np.searchsorted(vocabulary, chosen.term.to_numpy(np.int64).view(np.uint64))
        of = [(None if item != item else int(item), np.sort(g.to_numpy(np.int64))) for item, g in chosen.groupby("item_id", dropna=False).term]
        of = [(item, terms[weights[terms] > 0]) for item, terms in of]
        found.append(scratch.write(index.mapInArrow(_search(of, weights, n_docs, n_terms, k), _FOUND)))
        scratch.drop(index)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")


def oracle(k: int = TOP) -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "regexp_extract_all(" + lower + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH asked AS (SELECT DISTINCT item_id, unnest({words.format("text")}) AS term FROM benchmark),
doc AS (SELECT row_number() OVER () AS r, doc_id, {words.format("text")} AS words FROM documents),
total AS (SELECT count(*) AS n, CAST(sum(len(words)) AS BIGINT) AS l FROM doc WHERE len(words) > 0),
held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM doc)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, total GROUP BY term),
scored AS (
  SELECT a.item_id, h.r, CAST(sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (10 + (90 * len(d.words) * t.n) // t.l)))) AS BIGINT) AS score
  FROM asked a JOIN held h USING (term) JOIN weight w USING (term) JOIN doc d USING (r), total t GROUP BY a.item_id, h.r),
ranked AS (
  SELECT s.item_id, row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id NULLS FIRST) AS rank, d.doc_id, s.score
  FROM scored s JOIN doc d USING (r) WHERE s.score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
