"""Operator 5, and the pipeline against its parts' brute-force versions."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pedshade.llm import sharding, wfst


@pytest.mark.parametrize("shards", [24, 5])
def test_shards_are_even_and_keep_groups(docs, rows, shards):
    got = sharding.shard_documents(docs, shards).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_groups_meet_in_one_shard(spark):
    rows = [(i, f"text {i % 41 if i % 3 == 0 else 1000 + i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.shard for r in sharding.shard_documents(df, 6).collect()}
    held = defaultdict(Counter)
    for i, t in rows:
        held[t][got[i]] += 1
    cut = sum(sum(c.values()) - max(c.values()) for c in held.values())
    links = sum(sum(c.values()) - 1 for c in held.values())
    assert cut < 0.1 * links
    assert {r["cut"] for r in sharding.cut_edges(sharding.shard_documents(df, 6), df).collect()} == {cut}


@pytest.mark.parametrize("hot", [1000, 5])
def test_propagation_equals_a_plain_loop(spark, monkeypatch, hot):
    """Labels, requests, quotas and moves round by round over lists, hot groups joined apart or not."""
    from pyspark.sql import functions as F

    from pedshade.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    shards = 6
    texts = [(i, f"text {i % 17 if i % 3 == 0 else 1000 + i}") for i in range(400)]
    texts = [(i, "hot" if i % 5 == 1 else t) for i, t in texts]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.shard for r in sharding.shard_documents(df, shards).collect()}
    # Spark's hashes, which break ties and deal large groups, are taken from Spark.
    total, part = len(texts), 3 * len(texts) // (4 * shards)
    n = Counter(t for _, t in texts)
    parts = {t: -(-k // part) for t, k in n.items() if k > 1}
    hashed = df.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), F.xxhash64("doc_id", "doc_id").alias("row")).collect()
    asked = [(r.doc_id, r.a, r.b, r.row % parts[t]) for r, (_, t) in zip(sorted(hashed), texts, strict=True) if t in parts]
    named = spark.createDataFrame(asked, "i long, a long, b long, k long").select("i", F.xxhash64("a", "b", "k").alias("p")).collect()
    of = {r.i: r.p for r in named}
    tie = {(r.p, r.s): r.h for r in spark.createDataFrame([(p, s) for p in set(of.values()) for s in range(shards)], "p long, s long").select("p", "s", F.xxhash64("p", "s").alias("h")).collect()}
    shard = {i: i * shards // total for i, _ in texts}
    for _ in range(sharding.ROUNDS):
        held = defaultdict(Counter)
        for i, p in of.items():
            held[p][shard[i]] += 1
        to = {p: max(c, key=lambda s: (c[s], tie[p, s])) for p, c in held.items()}
        classes = defaultdict(list)
        for i, _ in texts:
            classes[shard[i], to[of[i]] if i in of else shards].append(i)
        want = np.array([[len(classes[s, t]) if s != t else 0 for t in range(shards)] for s in range(shards)])
        granted, moves = sharding.quotas(want, np.array([len(classes[s, shards]) for s in range(shards)]))
        if not granted.any():
            break
        for s in range(shards):
            for t in range(shards):
                for i in sorted(classes[s, t], key=lambda i: (of[i], i))[: granted[s, t]]:
                    shard[i] = t
            at = 0
            for t in range(shards):
                for i in classes[s, shards][at : at + moves[s, t]]:
                    shard[i] = t
                at += moves[s, t]
        if (granted == want).all():
            break
    assert got == shard


def test_a_group_beyond_a_shard_is_dealt_out(spark):
    df = spark.createDataFrame([(i, "same" if i % 10 else str(i)) for i in range(300)], "doc_id long, text string")
    got = sharding.shard_documents(df, 6).collect()
    assert set(Counter(r.shard for r in got).values()) == {50}


def test_quotas_keep_sizes():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        k = int(rnd.integers(2, 8))
        asked, free = rnd.integers(0, 30, (k, k)), rnd.integers(0, 20, k)
        granted, moves = sharding.quotas(asked, free)
        total = granted + moves
        assert (total.sum(axis=0) == total.sum(axis=1)).all() and (moves.sum(axis=1) <= free).all()
        assert (granted <= asked).all() and (granted >= 0).all() and not granted.diagonal().any()


def test_sharding_empty(empty):
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.skipif(not os.path.exists(wfst.MODEL_PATH), reason="no tokenizer file here")
def test_pipeline_stages(spark, tmp_path):
    """Each stage of the pipeline against brute force on its own input."""
    import corpus_pipeline
    from tests.llm.conftest import DOCS, corpus
    from tests.llm.test_dedup import brute_components, brute_fingerprint, brute_lines
    from tests.llm.test_text import brute_passages

    rows = corpus(11, 140)
    leak = rows[9][1] + " " + " ".join(f"quiz{k}" for k in range(20))
    rows[9] = (9, leak, *rows[9][2:])
    items = [(1, " ".join(f"quiz{k}" for k in range(20))), (2, "far too short")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in one) == Counter(r[0] for r in rows if r[1] and any(map(str.isalpha, r[1])))
    two = stages["line_dedup"](spark, docs, str(tmp_path))
    assert two.count() == len(rows) and two.columns == docs.columns
    want = brute_lines(rows, 0.1, 5)
    assert sum(r[2] for r in want) > 0
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r.doc_id, digest(r.text)) for r in two.collect()) == Counter((r[0], r[3]) for r in want.elements())
    three = [r.doc_id for r in stages["simhash_near_dedup"](spark, docs, str(tmp_path)).collect()]
    comp = brute_components([brute_fingerprint(r[1]) for r in rows])
    assert len(three) == len(set(comp))
    four = {r.doc_id for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()}
    assert four == {r[0] for r in rows} - {found[0] for found in brute_passages([(r[0], r[1]) for r in rows], items)}
    five = stages["sentencepiece"](spark, docs, str(tmp_path)).collect()
    m = wfst.compiled(wfst.read_model())
    text = {r[0]: r[1] for r in rows}
    assert len(five) == len(rows) and all((r.piece_ids or []) == m.encode(text[r.doc_id] or "").tolist() for r in five)
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(result) < len(rows) and 9 not in {r.doc_id for r in result}


@pytest.mark.skipif(not os.path.exists(wfst.MODEL_PATH), reason="no tokenizer file here")
def test_pipeline_of_empty_tables(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert all(stage(spark, docs, str(tmp_path)).columns == docs.columns for _, stage in corpus_pipeline.STAGES[:-1])
