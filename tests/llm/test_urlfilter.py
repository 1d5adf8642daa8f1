import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pedshade.llm import urlfilter as u

PAGES = "page_id long, url string, html string"
TEXT = "<p class='x'>The cheap flights of the spam. Flights to the lake; lake house in the town, the house</p>" * 3
ROWS = [
    (1, "http://cheapflights.example.org/en/1?x=1", TEXT),
    (2, "https://WWW.Cheap-Pills.example.com/de/45", TEXT),
    (3, "https://lakehouse.example.com/fr/7.html", None),
    (4, "https://lakehouse.example.org/es/7", ""),
    (5, "https://lakehouse.net/en/#top", "plain words"),
    (6, "https://freecasino.net/en/win", TEXT),
    (7, "http://org", None),
    (8, "http://org/", None),
    (9, "http://notorg/", None),
    (10, "http://a.com?x=/de/", None),
    (11, "no address", TEXT),
    (12, None, None),
    (13, "", None),
    (14, "x://y://z.org/q", None),
    (15, "http://Éxample.org/en/2", None),
    (None, "http://shop.cheapflights.net/fr/1", None),
    (6, "https://freecasino.net/en/win", TEXT),
]


def brute(rows, rules=u.RULES):
    counts = Counter()
    letters = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: t.translate(str.maketrans(u._UPPER, u._LOWER))
    for _, _, html in rows:
        counts.update(letters.findall(low(re.sub("<[^>]*>", " ", html or ""))))
    total = max(10, counts.total())
    for w in (*u.SUSPECT, *u.USUAL):
        counts[w] = max(counts[w], 1, int(total * u.LEAST_SHARE))
    parsed = []
    for page, url, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        bags = []
        for kind, text in (("host", host), ("path", path)):
            bag = []
            for unit in re.findall(r"[^\x00-\x60\x7B-\x7F]{1,63}|[0-9]+", low(text)):
                bag.append("#" if unit[0].isdigit() else unit)
            bags.append((kind, tuple(bag)))
        parsed.append((page, host, path, rule, verdict, bags))

    def tokens(bag):
        kind, units = bag
        return [f"{kind}:{w}" for unit in units for w in (["#"] if unit == "#" else likely(unit, counts, total))]

    seen = {(v, b[0], t) for *_, v, b in parsed if v for bag in b for t in tokens(bag)}
    sites = {(v, b[0]) for *_, v, b in parsed if v}
    n = {v: Counter(t for x, _, t in seen if x == v) for v in ("block", "allow")}
    size = {v: n[v].total() + len({t for *_, t in seen}) + 1 for v in n}
    prior = math.log((sum(v == "block" for v, _ in sites) + 1) / (sum(v == "allow" for v, _ in sites) + 1))
    known = {t for *_, t in seen} | {f"{k}:{w}" for k in ("host", "path") for w in u.SUSPECT}

    def weight(t):
        if t not in known:
            return 0
        b = n["block"][t] + (u.SUSPECT_SITES if t[5:] in u.SUSPECT else 0)
        return math.log((b + 1) / size["block"]) - math.log((n["allow"][t] + 1) / size["allow"])

    out = []
    for page, host, path, rule, verdict, bags in parsed:
        score = prior + sum(weight(t) for bag in bags for t in tokens(bag))
        out.append((page, host, path, rule, verdict or ("block" if score > 1e-9 else "allow"), round(score, 4)))
    return out


def likely(name, counts, total):
    """All splits of a short name, tried out."""
    best = None
    for cuts in range(1 << (len(name) - 1)):
        at = [0, *(i + 1 for i in range(len(name) - 1) if cuts >> i & 1), len(name)]
        words = [name[a:b] for a, b in zip(at, at[1:])]
        p = sum(math.log(counts[w] / total) if counts[w] else math.log(10 / total) - len(w) * math.log(10) for w in words)
        if best is None or p > best[0] + 1e-9:
            best = (p, words)
    return best[1]


def test_verdicts_against_plain_loops(spark):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3).withColumns({k: F.lit("x") for k in ("host", "path", "rule", "bag", "site", "tail", "unit", "word", "n", "label")})
    got = [(*r[:5], round(r[5], 4)) for r in u.judge_urls(pages).collect()]
    assert sorted(got, key=str) == sorted(brute(ROWS), key=str)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[6] == "block" and verdict[1] == "block" and verdict[2] == "block" and verdict[3] == "allow"


def test_words_of_names():
    counts = {"cheap": 50, "flights": 20, "flight": 30, "s": 1, "lake": 9}
    assert u.segment("cheapflights", counts, 1000) == ["cheap", "flights"]
    assert u.segment("lakexq", counts, 1000) == ["lake", "xq"]
    assert u.segment("", counts, 1000) == []


def test_empty_and_long(spark):
    empty = u.judge_urls(spark.createDataFrame([], PAGES))
    assert empty.columns == ["page_id", "host", "path", "rule", "verdict", "score"] and empty.count() == 0
    long = spark.createDataFrame([(1, "http://" + "lakehouse" * 3000 + ".net/" + "a/" * 5000, "<b>lake</b> house " * 400_000)], PAGES)
    row = u.judge_urls(long).first()
    assert len(row.host) == 27_004 and row.rule is None and row.verdict == "allow"


@pytest.mark.parametrize("copies", [3000])
def test_hot_sites_are_joined_whole(spark, copies):
    rows = [(i, "https://freecasino.net/en/win", "") for i in range(copies)] + ROWS
    got = u.judge_urls(spark.createDataFrame(rows, PAGES))
    assert got.count() == len(rows) and got.filter("verdict = 'block' and host = 'freecasino.net'").count() == copies + 2
