"""Language identification by hierarchical discrimination.

Linear support vector machines first tell language families apart; within the
family found, one machine for each pair of its languages votes on the closely
related candidates.  Features are hashed byte n-grams of the whole text.  Every
language is learned: codes of no known family are grouped by likeness into
families of bounded size, and the pairs are trained by tasks.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedshade.llm.common import bound_batches, in_blocks, load64, mix64, utf8

DIMENSIONS = 4096
ORDERS = (1, 2, 3, 4)
#: Training documents: this many for a language and in all, about, but ``LEAST`` for a language in any case.
PER_LANGUAGE, IN_ALL, LEAST = 600, 4000, 20
#: Languages of a family that is found by likeness, at most.
LARGEST_FAMILY = 16

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga gd cy br".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indo-aryan": "hi ur bn pa mr gu ne si".split(),
    "dravidian": "ta te kn ml".split(),
    "semitic": "ar he mt am".split(),
    "sinitic": "zh yue".split(),
    "austronesian": "id ms tl jv".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_PAD = 8
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).lower()


#: Longer texts are read in pieces of this size.
LONG_BYTES = 2 << 20


def has_letter(text: bytes) -> bool:
    decoder = codecs.getincrementaldecoder("utf-8")("ignore")
    return any(any(map(str.isalpha, decoder.decode(text[at : at + LONG_BYTES]))) for at in range(0, len(text), LONG_BYTES))


def features(values: list[bytes | None]) -> np.ndarray:
    """Unit vectors of log n-gram counts; what is no letter counts as a space."""
    counts = np.zeros((len(values), DIMENSIONS), np.float32)
    short = [i for i, v in enumerate(values) if len(v or b"") <= LONG_BYTES]
    counts[short] = _counts([values[i] for i in short])
    for i, v in enumerate(values):
        if len(v or b"") > LONG_BYTES:
            # A piece's n-grams read on into the next piece.
            whole = np.zeros(DIMENSIONS, np.float64)
            for at in range(0, len(v), LONG_BYTES):
                end = at + LONG_BYTES
                whole += _counts([v[at : end + _PAD]], min(LONG_BYTES, len(v) - at))[0]
            counts[i] = whole
    x = np.log1p(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _counts(values: list[bytes | None], own: int | None = None) -> np.ndarray:
    """Hashed n-gram counts; of a single text only of n-grams that start in its first ``own`` bytes."""
    n = len(values)
    texts = [(v or b"").translate(_LETTERS) for v in values]
    buf = np.frombuffer(bytes(_PAD).join(texts) + bytes(2 * _PAD), np.uint8)
    sizes = np.empty(2 * n, np.int64)
    sizes[0::2] = [len(t) for t in texts]
    sizes[1::2] = _PAD
    owner = np.empty(2 * n, np.int64)
    owner[0::2] = np.arange(n)
    owner[1::2] = n
    row = np.repeat(owner, sizes)[:own] * DIMENSIONS
    words = load64(buf)[: len(row)]
    counts = np.zeros((n + 1) * DIMENSIONS, np.float32)
    shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
    for order in ORDERS:
        gram = words & np.uint64((1 << 8 * order) - 1)
        at = (mix64(gram + np.uint64(order << 40)) >> shift).astype(np.int64)
        counts += np.bincount(row + at, minlength=len(counts))
    return counts.reshape(n + 1, DIMENSIONS)[:n]


def train_svm(x: np.ndarray, positive: np.ndarray, penalty: float = 2e-4, steps: int = 150, flat: float = 1e-5) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated descent until the loss is ``flat``."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum()).astype(np.float32)
    x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w = np.zeros(x1.shape[1], np.float32)
    ahead, momentum = w, 1.0
    rate = 1 / (2 * 2 + penalty)  # the loss's curvature is at most 2 |x|^2, and |x|^2 = 2 with the bias
    for _ in range(steps):
        short = np.maximum(0, 1 - y * (x1 @ ahead))
        grad = penalty * ahead - 2 * ((share * y * short) @ x1)
        if np.abs(grad).max() < flat:
            break
        step = ahead - rate * grad
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2  # plain numbers keep the arrays in single precision
        ahead = step + (momentum - 1) / after * (step - w)
        w, momentum = step, after
    return w


class OneVersusOne:
    """A linear machine for each pair of classes; the most votes win, then the wider margin."""

    def __init__(self, classes: list[str], w: Mapping[tuple[str, str], np.ndarray]):
        self.classes = sorted(classes)
        self.pairs = list(combinations(range(len(self.classes)), 2))
        held = [w[self.classes[a], self.classes[b]] for a, b in self.pairs]
        self.w = np.array(held, np.float32).reshape(len(held), DIMENSIONS + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers, and each one's least chance against any other class."""
        k = len(self.classes)
        if k == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margins = x @ self.w[:, :-1].T + self.w[:, -1]
        votes = np.zeros((len(x), k))
        chance = np.ones((len(x), k))
        for (a, b), m in zip(self.pairs, margins.T, strict=True):
            votes[:, a] += (m >= 0) + 0.01 * np.tanh(m)
            votes[:, b] += (m < 0) - 0.01 * np.tanh(m)
            p = 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
            chance[:, a] = np.minimum(chance[:, a], p)
            chance[:, b] = np.minimum(chance[:, b], 1 - p)
        best = votes.argmax(axis=1)
        return best, chance[np.arange(len(x)), best]


def families(x: np.ndarray, langs: np.ndarray) -> dict[str, str]:
    """The family of each language.

    Languages of unknown family are halved along the direction in which their
    mean features differ most until ``LARGEST_FAMILY`` or fewer are left.
    """
    out = {v: FAMILY_OF[v] for v in sorted(set(langs)) if v in FAMILY_OF}
    rest = [sorted(set(langs) - set(out))]
    while rest:
        group = rest.pop()
        if len(group) <= LARGEST_FAMILY:
            out |= {v: f"like {group[0]}" for v in group}
            continue
        means = np.array([x[langs == v].mean(axis=0) for v in group], np.float64)
        means -= means.mean(axis=0)
        _, axes = np.linalg.eigh(means @ means.T)
        main = axes[:, -1] * np.sign(axes[np.abs(axes[:, -1]).argmax(), -1])
        order = np.lexsort((np.arange(len(group)), main.round(9)))
        half = len(group) // 2
        rest += [sorted(group[i] for i in order[:half]), sorted(group[i] for i in order[half:])]
    return out


class Hierarchy:
    """Family first, then the languages within it."""

    def __init__(self, family_of: dict[str, str], weights: dict[bool, dict[tuple[str, str], np.ndarray]]):
        """``weights`` of pairs of families, under True, and of languages."""
        self.top = OneVersusOne(sorted(set(family_of.values())), weights[True])
        self.within = [OneVersusOne([v for v, f in family_of.items() if f == family], weights[False]) for family in self.top.classes]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fam, score = self.top.predict(x)
        lang = np.empty(len(x), object)
        for k, machine in enumerate(self.within):
            here = np.flatnonzero(fam == k)
            if len(here):
                got, p = machine.predict(x[here])
                lang[here] = np.array(machine.classes, object)[got]
                score[here] = score[here] * p
        return lang, score


def _train_pairs(shared, family_of: dict[str, str]):
    """Trains the pairs of classes, families or languages, in its rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, langs = shared.value
        labels = {True: np.array([family_of[v] for v in langs]), False: langs}
        for pdf in parts:
            for top, a, b in zip(pdf.top, pdf.a, pdf.b, strict=True):
                y = labels[bool(top)]
                here = np.flatnonzero((y == a) | (y == b))
                w = train_svm(x[here].astype(np.float32), y[here] == a)
                yield pd.DataFrame({"top": [top], "a": [a], "b": [b], "w": [w.tobytes()]})

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, values in in_blocks(batches, "text", most=256):
        x = features(values).astype(np.float16)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Hierarchy | None:
    """Fits the machines on about ``per_language`` documents of each language.

    Those are chosen by a hash of doc_id from the documents that are not held
    out and have lang, doc_id and text.  ``in_all`` lowers their number where
    there are many languages, to ``LEAST`` for each at the least, so that the
    sample, 8 KB a document, is bounded by the number of languages alone; a
    language of fewer documents is learned from all of them.  None if no
    document qualifies.
    """
    spark = docs.sparkSession
    pool = bound_batches(docs).filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    quota = max(LEAST, min(per_language, in_all // len(counts)))
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, quota / n))])
    lot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    sample = pool.filter(lot < share[F.col("lang")]).select("lang", utf8().alias("text"))
    got = sample.mapInArrow(_featurize, "lang string, x binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "x"], kind="stable")  # the same weights whatever order the rows came in
    x = np.frombuffer(b"".join(got.x), np.float16).reshape(len(got), DIMENSIONS)
    langs = got.lang.to_numpy().astype(str)
    family_of = families(x, langs)
    pairs = [(True, a, b) for a, b in combinations(sorted(set(family_of.values())), 2)]
    for family in sorted(set(family_of.values())):
        pairs += [(False, a, b) for a, b in combinations(sorted(v for v, f in family_of.items() if f == family), 2)]
    weights: dict[bool, dict[tuple[str, str], np.ndarray]] = {True: {}, False: {}}
    if pairs:
        shared = spark.sparkContext.broadcast((x, langs))
        tasks = spark.createDataFrame(pairs, "top boolean, a string, b string").repartition(min(len(pairs), spark.sparkContext.defaultParallelism))
        for r in tasks.mapInPandas(_train_pairs(shared, family_of), "top boolean, a string, b string, w binary").collect():
            weights[r["top"]][r["a"], r["b"]] = np.frombuffer(r["w"], np.float32)
    return Hierarchy(family_of, weights)


def _predictor(model: Hierarchy | None, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, values in in_blocks(batches, "text", most=256):
            lang, score = np.full(len(values), "und", object), np.zeros(len(values))
            some = [i for i, v in enumerate(values) if v and model is not None and has_letter(v)]
            if some:
                lang[some], score[some] = model.predict(features([values[i] for i in some]))
            if keep:
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(lang != "und"))], names=["row"])
            else:
                added = [pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1).astype(np.float64))]
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], *added], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def language_id(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``.

    Needs columns doc_id, text and lang; others are ignored, and only the text
    is an input of the prediction.  The model learns from the documents whose
    crc32(doc_id) mod 4 is not 2.  Null text, and text without a letter, is
    ``und`` with score 0, as is everything without a model.  A null doc_id is
    not held out and not learned from; repeated rows come out repeated; an
    empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), utf8().alias("text"))
    return rows.mapInArrow(_predictor(train(docs), False), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language can be told.

    Null texts and texts without a letter go, as does everything without a
    model.  A null doc_id stays; repeated rows come out repeated; an empty table
    gives an empty one; columns of any name pass through.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.mapInArrow(_predictor(train(docs), True), f"row {row.schema['row'].dataType.simpleString()}").select("row.*")
