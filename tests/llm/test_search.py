import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pedshade.llm import search as s

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(d, Counter(words(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in held:
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * c.total() * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def made(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["É", "éa", "ÅB", "x1"]
    say = lambda k: " ".join(rnd.choice(vocabulary[: rnd.choice([3, 10, 84])]).upper() if rnd.random() < 0.1 else rnd.choice(vocabulary) for _ in range(k))
    docs = [(i, say(rnd.randint(0, 40))) for i in range(n)]
    docs += [(None, say(20)), (n, None), (n + 1, ""), (n + 2, "!!! ..."), (3, docs[3][1]), (5, say(9)), (n + 3, "w1 " * 5000), (None, docs[2][1])]
    items = [(i, say(rnd.randint(1, 30))) for i in range(12)] + [(20, None), (21, ""), (22, "unheard of"), (2, say(5)), (None, say(6))]
    return docs, items


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("pass_terms", [200_000, 30])
def test_scores_against_a_full_scan(spark, pass_terms):
    docs, items = made(pass_terms, 300)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2).withColumns({k: F.lit("x") for k in ("n", "terms", "score", "rank")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    assert plain(s.ranked_search(d, i, pass_terms=pass_terms)) == sorted(brute(docs, items), key=str)


@pytest.mark.parametrize("window, run_docs, postings", [(4, 40, 10**9), (16, 10**9, 200), (8, 8, 10**9)])
def test_runs_and_windows_of_any_size(monkeypatch, window, run_docs, postings):
    for name, value in (("WINDOW", window), ("RUN_DOCS", run_docs), ("RUN_POSTINGS", postings)):
        monkeypatch.setattr(s, name, value)
    docs, items = made(window, 200)
    docs = [(d, t) for d, t in docs if d is not None]
    words_of = lambda texts, name: pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], pa.int64()), pa.array([(t or "").encode() for _, t in texts], pa.binary())], names=[name, "text"])
    asked = next(s._terms([words_of(items, "item_id")])).to_pandas()
    vocabulary = np.unique(asked.term.to_numpy(np.int64).view(np.uint64))
    index = list(s._index(vocabulary)([words_of(docs[:90], "doc_id"), words_of(docs[90:], "doc_id")]))
    lengths = np.concatenate([b.column(1).to_numpy() for b in index])
    weights = np.zeros(len(vocabulary), np.int64)
    for b in s._frequencies(b.select(["terms"]) for b in index):
        weights[b.column(0).to_numpy()] += b.column(1).to_numpy()
    n = int((lengths > 0).sum())
    weights = np.array([s.weight_of(int(df), n) for df in weights])
    of = [(None if i != i else int(i), np.unique(np.searchsorted(vocabulary, g.to_numpy(np.int64).view(np.uint64)))) for i, g in asked.groupby("item_id", dropna=False).term]
    got = [tuple(r) for b in s._search(of, weights, n, int(lengths.sum()), 10)(iter(index)) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(got, key=str) == sorted([(i, d, v) for i, _, d, v in brute(docs, items)], key=str)


@pytest.mark.parametrize("seed", range(6))
def test_walk_skips_and_keeps_the_best(seed, monkeypatch):
    rnd = np.random.default_rng(seed)
    monkeypatch.setattr(s, "WINDOW", 16)
    n, v, k = 3000, 12, 5
    weights = rnd.integers(1, 6000, v)
    share = rnd.choice([0.002, 0.02, 0.5], v)
    ids = rnd.permutation(n).astype(np.int64)
    sizes, terms = [], []
    for _ in range(n):
        held = np.flatnonzero(rnd.random(v) < share)
        sizes.append(len(held))
        terms.append(held)
    terms = np.concatenate(terms).astype(np.int32)
    tfs, lengths = rnd.integers(1, 4, len(terms)).astype(np.int32), rnd.integers(10, 500, n)
    run = s.Run(ids, lengths, terms, tfs, np.array(sizes), weights, n, int(lengths.sum()))
    best = s.Best(k)
    run.search(np.arange(v), best)
    full = np.zeros(n, np.int64)
    np.add.at(full, run.doc, run.impact)
    order = np.lexsort((ids, -full))[:k]
    assert best.scores.tolist() == full[order].tolist() and best.docs.tolist() == ids[order].tolist()
    # With the threshold known from the start, most windows are skipped.
    lists = [s.Postings(run.doc[a:b], run.impact[a:b]) for a, b in zip(run.cut[:-1], run.cut[1:]) if b > a]
    assert s.walk(lists, ids, best) < -(-n // 16)


def test_long_documents_have_exact_lengths():
    lengths, n_docs = np.array([3 * 10**9]), 10**11
    got = s.impacts_of(np.array([5]), lengths, np.array([7]), n_docs, 10**13)
    assert got[0] == 7 * (5 * 10**9 // (5000 + 8 * (10 + 90 * 3 * 10**9 * 10**11 // 10**13)))


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    columns = ["item_id", "rank", "doc_id", "score"]
    for d, i in ((empty, some), (docs, none), (docs.filter("false"), none), (docs.withColumn("text", F.lit("..")), some)):
        out = s.ranked_search(d, i)
        assert out.columns == columns and out.count() == 0


def test_sql_says_the_same(spark, tmp_path):
    docs, items = made(9, 120)
    con = duckdb.connect()
    spark.createDataFrame(docs, "doc_id long, text string").toPandas().to_parquet(tmp_path / "d.parquet")
    spark.createDataFrame(items, "item_id long, text string").toPandas().to_parquet(tmp_path / "i.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) doc_id, text FROM '{tmp_path}/d.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT CAST(item_id AS BIGINT) item_id, text FROM '{tmp_path}/i.parquet'")
    assert sorted(con.execute(s.oracle()).fetchall(), key=str) == sorted(brute(docs, items), key=str)
