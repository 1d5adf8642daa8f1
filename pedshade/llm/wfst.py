"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (rewrite rules,
squeezed white space, the dummy prefix, spaces as U+2581), a trie that accepts
every piece, and byte fallback, a path of byte pieces for each character
without a piece.  Composed with an input they give a lattice: its states are
positions, reached with the piece that ends there, its arcs the pieces that
start there.  Encoding is the lattice's shortest path in the tropical semiring
(weights add along a path, the least path wins), by relaxation from left to
right; each position is left once, so it is linear in the text.

For a unigram model an arc weighs minus its piece's score.  In a merge (BPE)
model scores tell the order of merges and not the worth of a path, so the
weight stands on pairs of arcs: one for a piece that may follow the one before
it, infinite for a piece that may not, because merging the two joined strings
gives something else.  Just one path of a text has neighbours that all agree,
the merge order's own result, and likewise each prefix has one; so a position
is reached with one piece at finite weight, and states need no more than it.
The weights of pairs are compiled when a pair first occurs.

User-defined pieces are cut out first, longest first, and never merge; unused
pieces merge, and come out as the two that merged last.

Decoding is the inverse machine: piece bytes in a row, U+2581 as a space, the
dummy prefix off.  Under the identity normaliser texts of valid UTF-8 without
U+2581 come back unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedshade.llm.common import bound_batches, in_blocks, utf8

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments whose paths are remembered, in each of two generations, in one Python worker.
MEMORY = 250_000
#: Characters of a text that are encoded at once; longer texts are cut where a word begins.
PART = 1 << 20
#: Positions after which the part of a segment's path that is certain is handed on.
FLUSH = 1 << 16

#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_UNKNOWN_PENALTY = 10.0
_INF = float("inf")
_CHARACTERS = 0x110000
_NOTHING: dict = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


def rewrite_rules(charsmap: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie of inputs, then their outputs, each ended by a zero byte."""
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units, outputs = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist(), charsmap[4 + size :]
    base = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    rules: dict[str, str] = {}
    walk = [(base(units[0]), b"")]
    while walk:
        node, key = walk.pop()
        for byte in range(1, 256):
            at = node ^ byte
            if at < len(units) and units[at] & 0x800000FF == byte:
                here, longer = at ^ base(units[at]), key + bytes([byte])
                if units[at] >> 8 & 1:
                    start = units[here] & 0x7FFFFFFF
                    rules[longer.decode("utf-8", "replace")] = outputs[start : outputs.index(0, start)].decode("utf-8", "replace")
                walk.append((here, longer))
    return rules


def _trie(words) -> dict:
    """A trie's states as dictionaries from a character to [next state, the value of the word that ends there or None]."""
    root: dict = {}
    for word, value in words:
        state, arc = root, None
        for ch in word:
            arc = state.setdefault(ch, [{}, None])
            state = arc[0]
        if arc:
            arc[1] = value
    return root


class Normaliser:
    """Rewrites by the longest rule at each place, then squeezes and escapes spaces and adds the dummy prefix."""

    def __init__(self, rules: dict[str, str], dummy_prefix: bool, squeeze: bool, escape: bool, kept: tuple[str, ...] = ()):
        self.dummy_prefix, self.squeeze, self.space = dummy_prefix, squeeze, SPACE if escape else " "
        # Pieces defined by the user pass unchanged, before any rule.
        self.tries = [_trie((k, k) for k in kept), _trie(rules.items())]
        heads = {k[0] for k in (*kept, *rules)}
        self.first = re.compile("[" + "".join(map(re.escape, sorted(heads))) + "]") if rules else None
        #: Whether a text can be cut before any space that follows something else.
        self.cuttable = not any(" " in k[1:] for k in rules)

    def rewrite(self, text: str) -> str:
        if self.first is None:
            return text
        out, done = [], 0
        at = self.first.search(text)
        while at:
            start, found = at.start(), None
            for state in self.tries:
                end = start
                while end < len(text) and (arc := state.get(text[end])) is not None:
                    end += 1
                    state, value = arc
                    if value is not None:
                        found = (end, value)
                if found:
                    break
            if found:
                out += [text[done:start], found[1]]
                done = found[0]
            at = self.first.search(text, found[0] if found else start + 1)
        out.append(text[done:])
        return "".join(out)

    def __call__(self, text: str, begins: bool = True, ends: bool = True) -> str:
        text = self.rewrite(text)
        if self.squeeze:
            text = re.sub(" +", " ", text)
            text = text.lstrip(" ") if begins else text
            text = text.rstrip(" " + self.space) if ends else text
        if text and begins and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", self.space)


class Transducer:
    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        kind, dummy_prefix, escape, squeeze, charsmap = UNIGRAM, True, True, True, b""
        for field, value in _fields(model):
            if field == 1:
                f = dict(_fields(value))
                score = float(np.frombuffer(f.get(2, bytes(4)), "<f4")[0])
                self.pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                f = dict(_fields(value))
                charsmap, dummy_prefix = f.get(2, b""), bool(f.get(3, 1))
                squeeze, escape = bool(f.get(4, 1)), bool(f.get(5, 1))
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are compiled")
        self.bpe = kind == BPE
        self.kinds = [t for *_, t in self.pieces]
        own = [p for p, _, t in self.pieces if t == USER_DEFINED]
        self.normalise = Normaliser(rewrite_rules(charsmap), dummy_prefix, squeeze, escape, tuple(own))
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.arcs = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, (*_, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.score = [s for _, s, _ in self.pieces]
        lowest = min((self.score[i] for i in self.arcs.values()), default=0.0)
        self.highest = max((self.score[i] for i in self.arcs.values() if self.kinds[i] == NORMAL), default=0.0)
        self.unknown_weight = _UNKNOWN_PENALTY - lowest
        self.own = re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True)))) if own and self.bpe else None
        self.trie = _trie((p, i) for p, i in self.arcs.items() if self.kinds[i] != USER_DEFINED or not self.bpe)
        self.longest = max(map(len, self.arcs), default=1)
        # Where no piece goes on after a space that follows something else, or over a line
        # feed, the shortest path splits there, and segments have paths of their own.
        space = self.normalise.space
        feed = "" if any("\n" in p for p in self.arcs) else "\n"
        split = not any(re.search(f"[^{space}]{space}", p) for p in self.arcs)
        self.segments = re.compile(f"\n|{space}+[^{space}{feed}]*|[^{space}{feed}]+" if feed else f"{space}+[^{space}]*|[^{space}]+") if split else None
        self.out = [
            bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, t in self.pieces
        ]
        self._spines: dict[str, tuple | None] = {}
        self._agree: dict[int, bool] = {}
        self._paths: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    # -- weights of pairs in a merge model ------------------------------

    def _merged(self, text: str, seen: list | None = None) -> list[str]:
        """The merge order's result for a short string, by definition.

        ``seen`` gets each merge as (parts before it, index of its left part).
        """
        parts = list(text)
        while len(parts) > 1:
            best, at = -_INF, -1
            for i in range(len(parts) - 1):
                piece = self.arcs.get(parts[i] + parts[i + 1])
                if piece is not None and self.kinds[piece] != USER_DEFINED and self.score[piece] > best:
                    best, at = self.score[piece], i
            if at < 0:
                break
            if seen is not None:
                seen.append((tuple(parts), at))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, piece: str) -> tuple | None:
        """How a piece's edges grow: (left edge's parts, right edge's parts, in order of falling score?, last two parts).

        None for a piece that its own merges don't give.
        """
        if piece not in self._spines:
            steps: list = []
            if self._merged(piece, steps) != [piece]:
                self._spines[piece] = None
            else:
                left, right, falling, last = [piece[0]], [piece[-1]], True, _INF
                for parts, at in steps:
                    new = parts[at] + parts[at + 1]
                    score = self.score[self.arcs[new]]
                    falling &= score < last
                    last = score
                    if at == 0:
                        left.append(new)
                    if at + 2 == len(parts):
                        right.append(new)
                self._spines[piece] = (left, right, falling, steps[-1][0] if steps else None)
        return self._spines[piece]

    def _agrees(self, before: str, piece: str) -> bool:
        """Whether merging the joined strings gives just these two pieces."""
        b = self._spine(piece)
        if b is None or not before:
            return b is not None
        a = self._spine(before)
        if a is None:
            return False
        if not (a[2] and b[2]):
            return self._merged(before + piece) == [before, piece]
        # Merges fall in score, so what stands at the border when a merge across
        # it would have its turn follows from the scores alone; ties go left.
        arcs, score, right, left = self.arcs, self.score, a[1], b[0]
        i = j = 0
        while True:
            over = arcs.get(right[i] + left[j])
            if over is not None and self.kinds[over] == USER_DEFINED:
                over = None
            x = score[arcs[right[i + 1]]] if i + 1 < len(right) else -_INF
            y = score[arcs[left[j + 1]]] if j + 1 < len(left) else -_INF
            if over is not None and score[over] > x and score[over] >= y:
                return False
            if x == y == -_INF:
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def _string(self, at: int) -> str:
        """Of a piece's number; characters without a piece have numbers of their own, as has the start."""
        n = len(self.pieces)
        return self.pieces[at][0] if at < n else chr(at - n) if at < n + _CHARACTERS else ""

    def _arc_weight(self, at: int | None, size: int) -> float:
        """Of one piece in a unigram model; a piece of the user's outweighs whatever else covers its bytes."""
        if at is None:
            return self.unknown_weight
        if self.kinds[at] == UNUSED:
            return _INF
        return 0.1 - size * self.highest if self.kinds[at] == USER_DEFINED else -self.score[at]

    # -- encoding --------------------------------------------------------

    def _emit(self, at: int, ids: list[int]) -> None:
        if at >= len(self.pieces):
            ids += [self.byte_ids[b] for b in self._string(at).encode()] if self.byte_ids else [self.unknown]
        elif self.bpe and self.kinds[at] == UNUSED and len(self.pieces[at][0]) > 1:
            for part in self._spine(self.pieces[at][0])[3]:
                self._emit(self.arcs.get(part, len(self.pieces) + ord(part[0])), ids)
        else:
            ids.append(at)

    def _relax_pairs(self, text: str, before: int) -> tuple[list[int], list[int]]:
        """``(back, last)`` for each position: where its piece starts, and the piece, -1 for a position at infinite weight.

        Finite weights of pairs are all one, and a position has one path of
        finite weight, so the first arc that reaches it is its shortest.
        """
        n, root, agree, first = len(text), self.trie, self._agree, len(self.pieces)
        stride = first + _CHARACTERS + 1
        back, last = [0] * (n + 1), [-1] * (n + 1)
        last[0] = before
        for start in range(n):
            if last[start] < 0:
                continue
            row = last[start] * stride
            state, end = root, start
            while end < n:
                arc = state.get(text[end])
                end += 1
                if arc is None:
                    if end > start + 1:
                        break
                    state, at = _NOTHING, None
                else:
                    state, at = arc
                if at is None:
                    if end > start + 1:
                        continue
                    at = first + ord(text[start])  # byte fallback
                if last[end] < 0:
                    ok = agree.get(row + at)
                    if ok is None:
                        if len(agree) >= 4 * MEMORY:
                            agree.clear()
                        ok = agree[row + at] = self._agrees(self._string(last[start]), self._string(at))
                    if ok:
                        back[end], last[end] = start, at
        return back, last

    def _relax_pieces(self, text: str, before: int) -> tuple[list[int], list[int]]:
        """The same where each piece has a weight of its own."""
        n, root, first = len(text), self.trie, len(self.pieces)
        weight, back, last = [0.0] + [_INF] * n, [0] * (n + 1), [before] + [-1] * n
        for start in range(n):
            if weight[start] == _INF:
                continue
            state, end = root, start
            while end < n:
                arc = state.get(text[end])
                end += 1
                if arc is None and end > start + 1:
                    break
                state, at = arc or (_NOTHING, None)
                if at is not None or end == start + 1:
                    w = weight[start] + self._arc_weight(at, len(text[start:end].encode()))
                    if w < weight[end]:
                        weight[end], back[end], last[end] = w, start, first + ord(text[start]) if at is None else at
        return back, last

    def shortest_path(self, text: str) -> list[int]:
        """Piece ids on the shortest path over the composition of the machines with ``text``.

        A long text is taken in windows: what all paths to a window's last
        positions have in common is certain, and the next window starts there.
        """
        ids: list[int] = []
        relax = self._relax_pairs if self.bpe else self._relax_pieces
        at, size, before = 0, max(FLUSH, 2 * self.longest), len(self.pieces) + _CHARACTERS
        while at < len(text):
            window = text[at : at + size]
            back, last = relax(window, before)
            stop = n = len(window)
            if at + n < len(text):
                live = {e for e in range(n - self.longest + 1, n + 1) if last[e] >= 0}
                while len(live) > 1:
                    far = max(live)
                    live.discard(far)
                    live.add(back[far])
                stop = live.pop()
            path, k = [], stop
            while k:
                path.append(last[k])
                k = back[k]
            for piece in reversed(path):
                self._emit(piece, ids)
            before = last[stop]
            size = 2 * size if not stop else max(FLUSH, 2 * self.longest)
            at += stop
        return ids

    def _path(self, segment: str) -> tuple[int, ...] | list[int]:
        """The segment's path, remembered in two generations."""
        got = self._older.get(segment)
        if got is None:
            got = self.shortest_path(segment)
        if len(segment) <= 60:
            if len(self._paths) >= MEMORY:
                self._older, self._paths = self._paths, {}
            self._paths[segment] = got = tuple(got)
        return got

    def _plain(self, text: str, ids: list[int]) -> None:
        """Appends the ids of a normalised text without pieces of the user's."""
        if self.segments is None:
            ids += self.shortest_path(text)
            return
        known, path = self._paths, self._path
        for segment in self.segments.findall(text):
            ids += known.get(segment) or path(segment)
            known = self._paths

    def encode_parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, a part of about ``PART`` characters at a time."""
        at, n = 0, len(text)
        while at < n:
            end = n
            if n - at > PART and self.normalise.cuttable and self.segments is not None:
                cut = _WORD_BEGINS.search(text, at + PART)
                end = cut.start() + 1 if cut else n
            part = self.normalise(text[at:end], at == 0, end == n)
            ids: list[int] = []
            if self.own is None:
                self._plain(part, ids)
            else:
                done = 0
                for m in self.own.finditer(part):
                    self._plain(part[done : m.start()], ids)
                    ids.append(self.arcs[m.group()])
                    done = m.end()
                self._plain(part[done:], ids)
            yield np.array(ids, np.int32)
            at = end

    def encode(self, text: str) -> np.ndarray:
        parts = list(self.encode_parts(text))
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts])

    # -- decoding ----------------------------------------------------------

    def decode(self, ids) -> str:
        out = self.out
        whole = b"".join(b"".join([out[i] for i in np.asarray(ids[at : at + PART]).tolist()]) for at in range(0, len(ids), PART))
        text = whole.decode("utf-8", "replace")
        if self.squeeze:
            return text.lstrip(" ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


#: A place before a space that follows something else.
_WORD_BEGINS = re.compile("[^ ](?= )")


_COMPILED: dict[str, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The transducer of a model's bytes, compiled once in a Python worker."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _COMPILED:
        _COMPILED[name] = Transducer(model)
    return _COMPILED[name]


def read_model(path: str = MODEL_PATH) -> bytes:
    """A model file's bytes, read on the driver; executors get them with their tasks."""
    with open(path, "rb") as f:
        return f.read()


def _encoder(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for rows, values in in_blocks(batches, "text"):
            ids, same = [], []
            for v in values:
                text = None if v is None else v.decode("utf-8", "replace")
                pieces = None if text is None else machine.encode(text)
                ids.append(pieces)
                same.append(None if text is None else machine.decode(pieces) == text)
            arrays = [rows.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "ids", "round_trip"])

    return run


def encode(docs: DataFrame, model: bytes, keep: list[Column] | None = None) -> DataFrame:
    """``row`` (a struct of the columns in ``keep``, by default all), ``ids`` of each whole text and ``round_trip``.

    ``round_trip`` tells whether the ids decode to the text again.  Null text
    has null ids and a null round_trip, empty text no ids.
    """
    row = F.struct(*(keep or [F.col(f"`{c}`") for c in docs.columns])).alias("row")
    schema = docs.select(row).schema["row"].dataType.simpleString()
    return bound_batches(docs).select(row, utf8().alias("text")).mapInArrow(
        _encoder(model), f"row {schema}, ids array<int>, round_trip boolean"
    )


def _decoder(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in batches:
            texts = [None if ids is None else machine.decode(ids) for ids in batch.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "decoded"])

    return run


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``row`` and ``decoded`` text of a table with columns row and ids."""
    schema = encoded.schema["row"].dataType.simpleString()
    return encoded.select("row", "ids").mapInArrow(_decoder(model), f"row {schema}, decoded string")


def _digests(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        low, high = min(machine.byte_ids.values(), default=-1), max(machine.byte_ids.values(), default=-2)
        for rows, values in in_blocks(batches, "text"):
            out = []
            for v in values:
                text = (v or b"").decode("utf-8", "replace")
                a = machine.encode(text).astype("<i4", copy=False)
                decoded = machine.decode(a)
                out.append(
                    (len(text), len(a), int(((a >= low) & (a <= high)).sum()), hashlib.sha256(a.tobytes()).hexdigest(),
                     hashlib.sha256(decoded.encode()).hexdigest(), decoded == text)
                )
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.bool_()]
            names = ["doc_id", "n_chars", "n_pieces", "n_byte_pieces", "ids_sha256", "decoded_sha256", "round_trip"]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *arrays], names=names)

    return run


def encode_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """Counts and digests of each text's pieces and of the text decoded from them.

    Needs columns doc_id and text; others are ignored.  ``ids_sha256`` is of
    the ids as little-endian 32-bit numbers.  Null text counts as empty: no
    pieces, and the empty text again.  ``round_trip`` is false where the text
    holds U+2581, which decodes as a space.  A null doc_id is kept; repeated
    rows come out repeated; an empty table gives an empty one.
    """
    return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(
        _digests(model),
        "doc_id long, n_chars long, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean",
    )
