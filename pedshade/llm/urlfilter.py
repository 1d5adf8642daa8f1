"""URL filters: rules first, then naive Bayes over the words of host and path.

Hosts such as ``cheapflights`` write their words in one.  A unigram model, its
counts taken from the text of all pages, splits every run of letters of a host
or path by Viterbi search.  A multinomial naive Bayes model, which learns from
the addresses that a rule judges, scores the words of the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedshade.llm.common import bound_batches, in_blocks, is_hot, join_spread, pieces, utf8
from pedshade.runtime import Scratch

#: Verdict, host and beginning of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Words of unwanted sites, each counted as seen on ``SUSPECT_SITES`` blocked sites.
SUSPECT = (
    "adult", "ads", "bet", "bets", "bingo", "casino", "cheap", "escort", "free", "gambling", "jackpot", "loan", "lottery", "payday",
    "pharmacy", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "viagra", "win", "xxx",
)
SUSPECT_SITES = 5
#: Words of addresses that texts seldom hold.
USUAL = ("asp", "blog", "com", "edu", "example", "forum", "gov", "htm", "html", "index", "info", "mail", "net", "news", "org", "php", "shop", "www")
#: Either kind has this share of all words at least.
LEAST_SHARE = 1e-4

#: A run of letters is split in stretches of at most so many, the longest label a host can have.
LONGEST = 63
_UNIT = rf"[^\x00-\x60\x7B-\x7F]{{1,{LONGEST}}}|[0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).lower()
_MARKUP = re.compile(rb"<[^>]*>")
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 200_000


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host and path of an address; both empty for null and without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    found = verdict = F.lit(None).cast("string")
    for verb, site, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(start)
        found = F.when(fits, F.lit(site + start)).otherwise(found)
        verdict = F.when(fits, F.lit(verb)).otherwise(verdict)
    return found, verdict


def units_of(text: Column) -> Column:
    """Runs of letters, and a mark for each run of digits."""
    units = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"({_UNIT})"), 1)
    return F.transform(units, lambda u: F.when(u.rlike("^[0-9]"), F.lit("#")).otherwise(u))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words = pa.array(list(held), pa.binary())
        return pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for _, values in in_blocks(batches, "text"):
        for v in values:
            for piece in pieces(_MARKUP.sub(b" ", v or b"")):
                held.update(piece.translate(_LETTERS).split())
        if len(held) > HELD_WORDS:
            yield out()
            held.clear()
    yield out()


def word_counts(pages: DataFrame, text: str = "html") -> DataFrame:
    """``(word, n)`` over whole texts, without their markup."""
    return bound_batches(pages).select(utf8(text).alias("text")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segment(name: str, counts: Mapping[str, int], total: int) -> list[str]:
    """The most likely words of a name; an unknown stretch costs a tenth for each letter.

    Of equally likely splits the one whose last word is longest.
    """
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        score, at = -math.inf, 0
        for start in range(end):
            n = counts.get(name[start:end])
            p = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            if best[start] + p > score:
                score, at = best[start] + p, start
        best.append(score)
        back.append(at)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def _segment_rows(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [segment(name, {k["word"]: k["n"] for k in known}, total) for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["unit", "words"])

    return run


def _hot(df: DataFrame, key: str) -> DataFrame:
    """Keys of a written table that hold over a thousandth of its rows, and over a thousand."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(is_hot(F.col("n"), df.count())).select(key)


def _joined(left: DataFrame, right: DataFrame, key: str, written: DataFrame | None = None) -> DataFrame:
    """A left join on one text key that may be hot; ``written`` is the table that ``left`` comes from."""
    spread = F.concat(F.lit("-"), F.xxhash64(*left.columns).cast("string"))
    return join_spread(left, right, [key], _hot(left if written is None else written, key), spread)


def split_units(units: DataFrame, counts: DataFrame) -> DataFrame:
    """``(unit, words)`` for distinct ``units``; their stretches meet the words of ``counts`` in a join.

    ``counts`` may have any size: only words that a unit holds are looked at.
    """
    total = max(10, counts.agg(F.sum("n")).first()[0] or 0)
    given = units.sparkSession.createDataFrame([(w, max(1, int(total * LEAST_SHARE))) for w in {*SUSPECT, *USUAL}], "word string, n long")
    counts = counts.unionByName(given).groupBy("word").agg(F.max("n").alias("n"))
    stretches = F.expr("array_distinct(flatten(transform(sequence(1, length(unit)), i -> transform(sequence(1, length(unit) - i + 1), n -> substring(unit, i, n)))))")
    held = Scratch(units.sparkSession, "stretches").write(units.select("unit", F.explode(stretches).alias("word")))
    known = _joined(held, counts, "word")
    listed = known.groupBy("unit").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("known"))
    return listed.mapInArrow(_segment_rows(total), "unit string, words array<string>")


def judge_urls(pages: DataFrame, rules=RULES, url: str = "url", text: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row of ``pages``.

    Needs page_id and the columns named; others are ignored.  The longest rule
    that fits decides; elsewhere the method blocks where ``score``, the log-odds
    of block against allow, is above 0.  A word counts once for a site and
    verdict, so that a site's number of pages has no weight, and a word of no
    judged site counts nothing.  An address that is null or has no ``://`` has
    an empty host and path, no words, and the prior's score.  Null texts count
    no words; repeated rows come out repeated; an empty table gives an empty one.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = parts_of(F.col(url))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    bag = lambda kind, col: F.concat(F.lit(f"{kind} "), F.concat_ws(" ", units_of(F.col(col))))
    rows = scratch.write(rows.select("*", rule.alias("rule"), verdict.alias("label"), bag("host", "host").alias("site"), bag("path", "path").alias("tail")))

    bags = scratch.write(rows.select(F.explode(F.array("site", "tail")).alias("bag")).distinct())
    words_of_bag = F.filter(F.split(F.expr("substring(bag, 6)"), " "), lambda u: u != "")  # behind the kind
    units = scratch.write(bags.select("bag", F.explode(words_of_bag).alias("unit")))
    split = scratch.write(split_units(units.select("unit").distinct(), scratch.write(word_counts(pages, text))))
    kind = F.substring("bag", 1, 4)
    tokens = (
        _joined(units, split, "unit")
        .select("bag", F.explode(F.transform("words", lambda w: F.concat_ws(":", kind, w))).alias("token"))
        .groupBy("bag", "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    tokens = scratch.write(tokens)

    weights, prior = fit(rows, tokens)
    weights = scratch.write(weights)
    scored = _joined(tokens, weights, "token")
    scores = scratch.write(scored.groupBy("bag").agg(F.sum(F.col("tf") * F.coalesce("weight", F.lit(0.0))).alias("s")))
    judged = rows
    for side in ("site", "tail"):
        judged = _joined(judged, scores.select(F.col("bag").alias(side), F.col("s").alias(f"{side}_s")), side, rows)
    score = F.round(F.lit(prior) + F.coalesce("site_s", F.lit(0.0)) + F.coalesce("tail_s", F.lit(0.0)), 6)
    method = F.when(score > 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), score.alias("score"))


def fit(rows: DataFrame, tokens: DataFrame) -> tuple[DataFrame, float]:
    """``(token, weight)`` and the prior: log-odds of block against allow, with one added to every count."""
    seen = rows.filter("label is not null").select("label", "site", "tail").distinct()
    # One list a bag, so that a bag of many sites can be joined in parts.
    lists = tokens.groupBy("bag").agg(F.collect_list("token").alias("tokens"))
    pairs = seen.select("label", "site", F.explode(F.array("site", "tail")).alias("bag")).distinct()
    pairs = Scratch(rows.sparkSession, "pairs").write(pairs)
    held = _joined(pairs, lists, "bag").select("label", "site", F.explode("tokens").alias("token")).distinct()
    blocked, allowed = (F.count_if(F.col("label") == v) for v in ("block", "allow"))
    counts = Scratch(rows.sparkSession, "counts").write(held.groupBy("token").agg(blocked.alias("b"), allowed.alias("a")))
    b, a, v = counts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count(F.lit(1))).first()
    given = [(f"{kind}:{w}", SUSPECT_SITES, 0) for w in SUSPECT for kind in ("host", "path")]
    # Suspect words weigh as if seen, but their places are no part of the classes' sizes.
    counts = counts.unionByName(rows.sparkSession.createDataFrame(given, "token string, b long, a long"))
    counts = counts.groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    sites = {r["label"]: r["n"] for r in pairs.filter("bag = site").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = math.log((sites.get("block", 0) + 1) / (sites.get("allow", 0) + 1))
    weight = F.log((F.col("b") + 1) / F.lit(float(b + v + 1))) - F.log((F.col("a") + 1) / F.lit(float(a + v + 1)))
    return counts.select("token", weight.alias("weight")), prior
