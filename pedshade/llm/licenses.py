"""License scans: Aho-Corasick over normalised words, and license expressions.

One automaton finds the notice phrases and the identifier tag in a single pass
over the words of a text.  Where the tag stands, a shunting-yard parser reads
the expression behind it and evaluates its and/or/with operators.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedshade.llm.common import bound_batches, in_blocks, pieces, utf8

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notice phrases and their labels.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "creative commons": "cc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "no warranty": "no-warranty",
}
TAG = "spdx license identifier"

#: Weight of each kind of evidence in the score.
BASE_WEIGHT, NOTICE_WEIGHT, TAG_WEIGHT = 0.6, 0.5, 0.95

#: Beginnings of the identifiers whose licences ask nothing of a derived work.
PERMISSIVE = ("mit", "bsd", "isc", "apache", "zlib", "bsl", "cc0", "cc-by-4", "cc-by-3", "unlicense", "0bsd", "python", "postgresql")

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_TAG_LINE = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[a-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, list[tuple[str, str]]] = {}
    for phrase, label in BASE.items():
        kinds.setdefault(phrase, []).append(("base", label))
    for phrase, label in NOTICES.items():
        kinds.setdefault(phrase, []).append(("notice", label))
    kinds.setdefault(TAG, []).append(("tag", ""))
    for phrase, what in kinds.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, what))
    a.make_automaton()
    return a


def to_postfix(expression: str) -> list[str] | None:
    """Shunting yard: with binds tightest, then and, then or.  None if malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression.lower()):
        if token in _BINDS:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        else:
            if not operand_next:
                break  # prose after the expression
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """Identifiers of an expression, and whether a permissive choice satisfies it."""
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append(({token.rstrip("+") or token}, token.startswith(PERMISSIVE)))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            if len(a[0]) != 1 or len(b[0]) != 1:
                return None
            stack.append(({f"{min(a[0])}-with-{min(b[0])}"}, a[1]))
        else:
            small, large = sorted((a[0], b[0]), key=len)
            large |= small  # in place: each identifier moves into a larger set, so chains of any length stay cheap
            stack.append((large, (a[1] and b[1]) if token == "and" else (a[1] or b[1])))
    return stack[0]


def scan(text: bytes, machine: ahocorasick.Automaton) -> tuple:
    """(words, base places, first and last base word, base labels, labels, score, permissive)."""
    # A piece at a time, as a long text's words take many times its bytes.
    plain = b" ".join(filter(None, (b" ".join(p.translate(_TABLE).split()) for p in pieces(text))))
    n_words = plain.count(b" ") + 1 if plain else 0
    joined = f" {plain.decode('utf-8', 'replace')} "
    del plain
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    doubt, tagged = 1.0, False
    seen: set[tuple[str, str]] = set()
    at, counted = 0, 0
    for end, (length, kinds) in machine.iter(joined):
        start = end - length + 1
        for kind, label in kinds:
            if kind == "tag":
                tagged = True
                continue
            labels.add(label)
            if kind == "base":
                # Spaces before a phrase's own leading space are the words before it.
                counted += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
                at = start
                places.append(counted)
                base.add(label)
            if (kind, label) not in seen:
                seen.add((kind, label))
                doubt *= 1 - (BASE_WEIGHT if kind == "base" else NOTICE_WEIGHT)
    permissive = None
    if tagged:
        for m in _TAG_LINE.finditer(text):
            got = evaluate(m[1].decode("utf-8", "replace"))
            if got:
                labels |= got[0]
                permissive = got[1] if permissive is None else permissive and got[1]
                doubt *= 1 - TAG_WEIGHT
    return (
        n_words, len(places), min(places) if places else None, max(places) if places else None,
        ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - doubt, 6), permissive,
    )


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, permissive boolean"
)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
    for rows, values in in_blocks(batches, "text"):
        got = list(zip(*(scan(v or b"", machine) for v in values), strict=True))
        arrays = [rows.column(0), *(pa.array(c, k) for c, k in zip(got, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _SCHEMA.split(", ")])


def license_scan(docs: DataFrame) -> DataFrame:
    """One row of :func:`scan` for each row of ``docs``.

    Needs columns doc_id and text; others are ignored.  Null text counts as
    empty: no words, no labels, score 0.  ``permissive`` is null without a
    readable identifier tag.  A null doc_id is kept; repeated rows come out
    repeated; an empty table gives an empty one.
    """
    return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(_scan_batches, _SCHEMA)
