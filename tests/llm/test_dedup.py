"""Operators 1, 4 and 7 against brute-force versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pedshade.llm import linededup, simhash, substrings, suffix


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_matches_brute_force(docs, rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(prints)
    least = defaultdict(list)
    for r, c in zip(rows, comp, strict=True):
        if r[0] is not None:
            least[c].append(r[0])
    want = Counter((r[0], f"{p:016x}", min(least[c], default=None)) for r, p, c in zip(rows, prints, comp, strict=True))
    got = Counter(tuple(r) for r in simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect())
    assert got == want


def test_fingerprints_of_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(9)
    texts = [" ".join("w" * rnd.randint(1, 30) + str(rnd.randrange(9)) for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 40, 300]))) for _ in range(60)]
    texts += ["\t\n ", "x" * 200, None, "é" * 50 + "\x0b" + "É ß A"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([None if t is None else t.encode() for t in texts], pa.binary())], names=["doc_id", "text"])
    want = [brute_fingerprint(t) for t in texts]
    for limit in (simhash.LONG_BYTES, 37):
        monkeypatch.setattr(simhash, "LONG_BYTES", limit)
        got = [x for b in simhash._fingerprint_batches(iter([batch])) for x in b.column(1).to_numpy().view(np.uint64).tolist()]
        assert got == want


def test_keep_one_of_sets_that_share_ids(spark):
    """Two linked sets with the same smallest doc_id, null ids, and rows repeated: each set keeps one row."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "far away from all the other texts here")
    rows = [(4, a), (12, a), (4, b), (10, b), (11, b), (None, c), (None, c), (None, "unlike anything else that stands above")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(4, a), (4, b), (None, c), (None, rows[-1][1])])


def test_simhash_links_distance_four_only(spark, monkeypatch):
    """Every pattern of up to four flipped bits meets at an anchor; five does not link."""
    rnd = random.Random(1)
    base = rnd.getrandbits(64)
    pairs = []
    for k in range(600):
        bits = rnd.sample(range(64), 4 if k % 2 else rnd.randint(1, 4))
        x = rnd.getrandbits(64)
        pairs.append((x, x ^ sum(1 << b for b in bits)))
    far = (base, base ^ 0b11111)
    fps = np.array(sorted({f for p in [*pairs, far] for f in p}), np.uint64)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    label = {r[0]: r[1] for r in simhash.connected_components(simhash.fingerprint_links(df)).collect()}
    signed = lambda f: int(np.uint64(f).view(np.int64))
    for a, b in pairs:
        assert label[signed(a)] == label[signed(b)]
    assert label.get(signed(far[0]), 1) != label.get(signed(far[1]), 2)


def test_simhash_hot_anchor_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    near = {base}
    for _ in range(150):
        near.add(rnd.choice(sorted(near)) ^ (1 << rnd.randrange(64)))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in near], "fp long")
    got = simhash.connected_components(simhash.fingerprint_links(df)).collect()
    assert len(got) == len(near) and len({r[1] for r in got}) == 1


def test_golay_code_is_perfect():
    patterns, first = simhash.golay_cosets()
    assert len(first) == 2049
    weights = np.bitwise_count(patterns[first[:-1]])
    assert weights.max() == 3 and all(np.bitwise_count(patterns[a:b]).max() <= 4 for a, b in zip(first[:-1], first[1:], strict=True))


def test_simhash_empty_and_stage(empty, docs, rows):
    assert simhash.simhash_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {(r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len({c for _, c in groups})


def test_keep_one_chooses_by_set_not_by_id(spark):
    """Unlinked documents may share a doc_id, null or not, and each set keeps one row."""
    say = lambda seed: " ".join(random.Random(seed).choices([f"word{k}" for k in range(500)], k=80))
    rows = [(None, say(1)), (None, say(2)), (None, say(2)), (5, say(3)), (5, say(4)), (6, say(5)), (7, say(6)), (6, say(6)), (None, say(7)), (8, say(7)), (None, None)]
    comp = brute_components([brute_fingerprint(t) for _, t in rows])
    assert len(set(comp)) == 8
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # Texts 5 and 6 share doc_id 6, text 6 also has 7; text 7 has null and 8.
    want = [(None, say(1)), (None, say(2)), (5, say(3)), (5, say(4)), (6, say(5)), (6, say(6)), (8, say(7)), (None, None)]
    assert Counter(map(tuple, got)) == Counter(want)


def brute_removed(rows):
    """Bytes removed by doc_id, from the definition."""
    spans, first = defaultdict(set), {}
    signed = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), seed=42)).view(np.int64))
    same = {t: signed(t) for _, t in rows}
    rows = [((i, t), t) for i, t in rows]
    key = lambda d: (-(2**63) if d[0] is None else d[0], same[d[1]])
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            first[w] = min(first.get(w, (key(i), k)), (key(i), k))
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] < (key(i), k):
                spans[key(i)].update(range(k, k + 100))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = [k in spans[key(i)] for k in range(len(b))]
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[(i[0], len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_substrings_of_shared_and_null_ids(spark):
    """Texts that share a doc_id, or have none, lose their own repeats and not each other's places."""
    rnd = random.Random(12)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, b, c = say(150), say(220), say(130)
    rows = [(5, a + b), (5, c + say(90)), (5, c + say(90)), (7, a), (None, b + say(40)), (None, say(300)), (None, say(10) + c), (3, say(200)), (9, b)]
    rows += [rows[1], (None, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in substrings.dedup_substrings(df).collect()) == brute_removed(rows)


@pytest.mark.parametrize("piece", [2, 8_000])
def test_substrings_match_brute_force(docs, rows, piece):
    got = Counter(tuple(r) for r in substrings.dedup_substrings(docs, piece).collect())
    assert got == brute_removed([(r[0], r[1]) for r in rows])


def test_substrings_of_a_hot_core_are_dealt_out(spark):
    """One string of 104 bytes in ever more surroundings: units stay as small, and the result is the brute-force one."""
    rnd = random.Random(6)
    say = lambda k: "".join(rnd.choice("abcdefghij") for _ in range(k))
    core = say(104)
    rows = [(i, say(60) + core + say(60)) for i in range(6000)]
    for n in (1500, 6000):
        df = spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(6)
        units = substrings.cut_contexts(df, 200)[2].groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.max("dealt").alias("dealt"))
        most = units.agg(F.max("n"), F.count_if("dealt")).first()
        assert most[0] < 400 and most[1] >= n // 200
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.dedup_substrings(df, 200).collect()}
        # An earlier text's core goes on to the left and right as far as its bytes there are the same.
        before, behind = set(), set()
        for i, text in rows[:n]:
            left, right = text[:60][::-1], text[-60:]
            more = sum(max(k for k in range(61) if k == 0 or side[:k] in seen) for side, seen in ((left, before), (right, behind)))
            assert got[i] == ((104 + more, 1) if i else (0, 0))
            before |= {left[:k] for k in range(1, 61)}
            behind |= {right[:k] for k in range(1, 61)}
    few = rows[:400]
    df = spark.createDataFrame(few, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in substrings.dedup_substrings(df, 30).collect()) == brute_removed(few)


def test_substrings_periodic_and_exact_lengths(spark):
    rnd = random.Random(5)
    s = "".join(rnd.choice("abcdef é") for _ in range(400))
    rows = [(1, "a" * 350), (2, "a" * 100), (3, "xy" * 200), (4, s), (5, s[:99]), (6, s[10:110]), (7, "q" + s[50:300] + "z"), (8, s * 3), (9, "a" * 99), (10, "\x00" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece in (2, 8_000):
        got = Counter(tuple(r) for r in substrings.dedup_substrings(df, piece).collect())
        assert got == brute_removed(rows)


def test_substrings_long_text_in_pieces(spark):
    """A text beyond the piece size repeats itself across the pieces' border."""
    rnd = random.Random(6)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(700_000))
    b = "".join(rnd.choice("abcdefgh ") for _ in range(500_000))
    df = spark.createDataFrame([(1, a + b + a[:1000])], "doc_id long, text string")
    r = substrings.dedup_substrings(df).first()
    assert (r.n_bytes, r.n_removed, r.n_spans) == (1_201_000, 1000, 1)


def test_substrings_empty(empty):
    assert substrings.dedup_substrings(empty).count() == 0


def test_suffix_arrays_and_common_prefixes():
    rnd = random.Random(3)
    for _ in range(200):
        s = bytes(rnd.randrange(rnd.choice([1, 2, 3, 26])) for _ in range(rnd.randint(1, 150))) * rnd.choice([1, 1, 3])
        t = np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1, 0).astype(np.uint16)
        sa = suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(len(s) + 1), key=lambda i: s[i:])
        plcp = suffix.permuted_lcp(np.frombuffer(s, np.uint8), sa)
        for k in range(1, len(sa)):
            i, j, n = int(sa[k]), int(sa[k - 1]), 0
            while max(i, j) + n < len(s) and s[i + n] == s[j + n]:
                n += 1
            assert plcp[i] == n


def brute_lines(rows, ratio, least):
    hosts = defaultdict(list)
    for r in rows:
        hosts[r[3]].append(r[1])
    often = set()
    for h, texts in hosts.items():
        n = Counter(line for t in texts if t is not None for line in set(t.split("\n")))
        often |= {(h, line) for line, k in n.items() if k >= least and k > ratio * len(texts) and line.strip()}
    out = Counter()
    for i, t, _, h, _ in rows:
        if t is None:
            out[(i, 0, 0, None)] += 1
            continue
        lines = t.split("\n")
        kept = [x for x in lines if (h, x) not in often]
        out[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def test_line_dedup_matches_brute_force(docs, rows):
    got = Counter(tuple(r) for r in linededup.line_dedup(docs, max_ratio=0.05, min_pages=3).collect())
    want = brute_lines(rows, 0.05, 3)
    assert got == want and sum(r[2] for r in want) > 0


def test_line_dedup_keeps_columns_and_rows(docs, empty):
    out = linededup.drop_boilerplate(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert linededup.line_dedup(empty).count() == 0
