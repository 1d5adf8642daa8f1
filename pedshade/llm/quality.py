"""Quality classification by hierarchical empirical Bayes.

A document classifier turns each whole text into log-odds.  Its evidence is
gathered by host and by path: a host's rate is shrunk toward the global rate
and a path's toward its host's, each by a prior strength estimated from how
much the sites' rates differ beyond chance.  A document's result is its own
log-odds plus the log-odds by which its site, less the document itself,
departs from the global rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedshade.llm.common import bound_batches, in_blocks, utf8, word_hashes
from pedshade.runtime import Scratch

TARGETS = ("quality", "toxic")
#: Labelled documents that the document classifier learns from, about.
SAMPLE = 12_000
#: Buckets of hashed words, and the strongest words of a text that count.
WORD_BITS, TOP = 18, 3
#: Evidence of one document for its site is kept within these odds.
_CLIP = 8.0


def _shape(values: list[bytes | None], words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte frequencies, length, and how much of a text repeats."""
    n = len(values)
    out = np.zeros((n, 132), np.float32)
    for i, v in enumerate(values):
        v = v or b""
        buf = np.frombuffer(v, np.uint8)
        counts = np.zeros(129, np.int64)
        for at in range(0, len(buf), 1 << 20):
            counts += np.bincount(np.minimum(buf[at : at + (1 << 20)], 128), minlength=129)
        out[i, :129] = np.sqrt(counts / max(1, len(buf)))
        own = words[ends[i - 1] if i else 0 : ends[i]]
        if len(own):
            _, c = np.unique(own, return_counts=True)
            out[i, 129] = len(c) / len(own)
            out[i, 130] = c.max() / len(own)
        out[i, 131] = np.log1p(len(buf)) / 10
    return out


def _raw(values: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    words, ends = word_hashes(values)
    shape = _shape(values, words, ends)
    buckets = (words >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    return shape, [np.unique(buckets[ends[i - 1] if i else 0 : ends[i]]) for i in range(len(values))]


@dataclass
class Classifier:
    """Log-odds of one target: a logistic model over a text's shape and its most telling words."""

    word_odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def lexical(self, distinct: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(distinct), 2 * TOP), np.float32)
        for i, d in enumerate(distinct):
            odds = np.sort(self.word_odds[d])
            k = min(TOP, len(odds))
            out[i, :k] = np.maximum(odds[::-1][:k], 0)
            out[i, TOP : TOP + k] = np.minimum(odds[:k], 0)
        return out

    def log_odds(self, shape: np.ndarray, distinct: list[np.ndarray]) -> np.ndarray:
        x = (np.concatenate([shape, self.lexical(distinct)], axis=1) - self.mean) / self.scale
        return x @ self.weights[:-1] + self.weights[-1]


def word_log_odds(distinct: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """Log-odds of each word bucket, drawn toward 0 by two standard errors."""
    size = 1 << WORD_BITS
    a, b = np.zeros(size), np.zeros(size)
    for d, p in zip(distinct, positive, strict=True):
        (a if p else b)[d] += 1
    na, nb = positive.sum(), (~positive).sum()
    odds = np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))
    error = 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return (np.sign(odds) * np.maximum(0, np.abs(odds) - error)).astype(np.float32)


def fit(shape: np.ndarray, distinct: list[np.ndarray], positive: np.ndarray, steps: int = 400, penalty: float = 1e-3) -> Classifier:
    model = Classifier(word_log_odds(distinct, positive), np.zeros(0), np.zeros(0), np.zeros(0))
    x = np.concatenate([shape, model.lexical(distinct)], axis=1)
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = np.concatenate([(x - model.mean) / model.scale, np.ones((len(x), 1), np.float32)], axis=1)
    y = positive.astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, momentum = w, 1.0
    rate = 4 / (np.linalg.norm(x, 2) ** 2 / len(x) + 4 * penalty)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        step = ahead - rate * (x.T @ (p - y) / len(x) + penalty * ahead)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = step + (momentum - 1) / after * (step - w)
        w, momentum = step, after
    model.weights = w
    return model


def _collector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, values in in_blocks(batches, "text", most=2000):
        shape, distinct = _raw(values)
        yield pa.RecordBatch.from_arrays(
            [*rows.columns[:3], pa.array([s.tobytes() for s in shape], pa.binary()), pa.array([d.tobytes() for d in distinct], pa.binary())],
            names=["doc_id", *TARGETS, "shape", "words"],
        )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, Classifier | float]:
    """A classifier for each target from about ``sample`` labelled documents.

    They are chosen by a hash of doc_id.  A target without both classes in
    the sample gets a constant instead: its rate's log-odds.
    """
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.col(t).cast("int")).alias(t) for t in TARGETS])
    total = known.count()
    lot = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000))
    few = known.filter(lot < int(min(1.0, sample / max(1, total)) * 1_000_000))
    rows = (
        docs.select("doc_id", utf8().alias("text"))
        .join(F.broadcast(few), "doc_id")  # about ``sample`` rows of three numbers
        .select(F.col("doc_id").cast("long").alias("doc_id"), *TARGETS, "text")
    )
    got = rows.mapInArrow(_collector, "doc_id long, quality int, toxic int, shape binary, words binary").toPandas()
    got = got.sort_values(["doc_id", "shape", "words"], kind="stable").reset_index(drop=True)
    models: dict[str, Classifier | float] = {}
    for t in TARGETS:
        own = got[got[t].notna()]
        positive = own[t].to_numpy(np.int64) > 0 if len(own) else np.zeros(0, bool)
        rate = (positive.sum() + 0.5) / (len(own) + 1)
        if len(own) < 20 or not 0 < positive.sum() < len(own):
            models[t] = float(np.log(rate / (1 - rate)))
            continue
        shape = np.frombuffer(b"".join(own["shape"]), np.float32).reshape(len(own), -1)
        models[t] = fit(shape, [np.frombuffer(w, np.int32) for w in own["words"]], positive)
    return models


def _scorer(models: dict[str, Classifier | float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, values in in_blocks(batches, "text", most=2000):
            shape, distinct = _raw(values)
            z = [
                np.full(len(values), m) if isinstance(m, float) else m.log_odds(shape, distinct).astype(np.float64)
                for m in (models[t] for t in TARGETS)
            ]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:3], *(pa.array(np.clip(v, -_CLIP, _CLIP)) for v in z)],
                names=["doc_id", "host", "path", *(f"z_{t}" for t in TARGETS)],
            )

    return run


def _chance(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _strength(sites: DataFrame, n: str, s: str, q: str, within: Column) -> float:
    """Prior strength, in documents, from the spread of site rates beyond chance.

    ``within`` is the rate that a site is shrunk toward; method of moments.
    """
    r = sites.agg(
        F.sum(F.col(n) * (F.col(s) / F.col(n) - within) ** 2).alias("between"),
        F.sum(F.col(q) / F.col(n) - (F.col(s) / F.col(n)) ** 2).alias("chance"),
        F.sum(n).alias("n"),
        F.sum(F.col(q) - F.col(s) ** 2 / F.col(n)).alias("inside"),
    ).first()
    if not r["n"]:
        return 1.0
    spread = max(1e-6, (r["between"] - r["chance"]) / r["n"])
    noise = max(1e-6, r["inside"] / r["n"])
    return float(min(1e5, max(1.0, noise / spread)))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, evidence_quality, evidence_toxic, quality, toxic, keep)`` for every row of ``docs``.

    ``evidence_*`` is the document classifier's chance alone, ``quality`` and
    ``toxic`` the chance with the site's posterior; ``keep`` asks for at least
    an even chance of quality and less than that of toxicity.  Needs columns
    doc_id and text beside those in ``host`` and ``path``; ``labels`` has doc_id,
    quality and toxic.  Null text counts as empty, a null host or path as a
    site of its own; of several labels for a document the largest counts; a
    null doc_id has no label; repeated rows come out repeated; either table may
    be empty.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    models = train(docs, labels, sample)
    rows = bound_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(host.cast("string"), F.lit("\0")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("\0")).alias("path"),
        utf8().alias("text"),
    )
    names = [f"z_{t}" for t in TARGETS]
    scored = scratch.write(
        rows.mapInArrow(_scorer(models), "doc_id long, host string, path string, " + ", ".join(f"{z} double" for z in names))
    )
    sums = [a for t in TARGETS for a in (F.sum(_chance(F.col(f"z_{t}"))).alias(f"s_{t}"), F.sum(_chance(F.col(f"z_{t}")) ** 2).alias(f"q_{t}"))]
    paths = scratch.write(scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums))
    hosts = scratch.write(
        paths.groupBy("host").agg(
            F.sum("n").alias("hn"),
            *[F.sum(f"{a}_{t}").alias(f"h{a}_{t}") for t in TARGETS for a in "sq"],
        )
    )
    total = hosts.agg(F.sum("hn").alias("n"), *[F.sum(f"hs_{t}").alias(t) for t in TARGETS]).first()
    sites = paths.join(hosts, "host")
    final = []
    for t in TARGETS:
        rate = min(1 - 1e-4, max(1e-4, (total[t] or 0.0) / (total["n"] or 1.0)))
        host_strength = _strength(hosts, "hn", f"hs_{t}", f"hq_{t}", F.lit(rate))
        path_strength = _strength(sites, "n", f"s_{t}", f"q_{t}", F.col(f"hs_{t}") / F.col("hn"))
        own = _chance(F.col(f"z_{t}"))
        at_host = (F.col(f"hs_{t}") - own + F.lit(rate * host_strength)) / (F.col("hn") - 1 + F.lit(host_strength))
        at_path = (F.col(f"s_{t}") - own + at_host * F.lit(path_strength)) / (F.col("n") - 1 + F.lit(path_strength))
        p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), at_path))
        shift = F.log(p / (1 - p)) - F.lit(float(np.log(rate / (1 - rate))))
        final.append((own.alias(f"evidence_{t}"), _chance(F.col(f"z_{t}") + shift).alias(t)))
    columns = [c for pair in zip(*final, strict=True) for c in pair]
    return (
        scored.join(sites, ["host", "path"])
        .select("doc_id", *columns)
        .withColumn("keep", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))
    )
