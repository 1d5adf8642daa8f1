"""Conversation structure repair: rank-convergence parallel Viterbi.

Cheapest edits turn a conversation's roles into ``(s?(ua)+)?``.  Backward costs
are vectors over the automaton's four states; as only their differences steer
the choice, vectors that differ by a constant are one.  Conversations are cut
into chunks.  Each chunk starts at its end from a speculative vector; fix-up
passes start it again from its right neighbour's vector and stop where the new
vectors meet the old ones.  The blocks that one task fixes double with every
pass, so passes stay few even where vectors never meet.  The stitched costs
then drive a forward walk that takes the least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedshade.llm.common import bound_batches
from pedshade.runtime import Scratch

#: Rows and bytes of text at which a chunk ends.
CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20

#: What edits cost.  Undeleted truncated rows cost ``TRUNCATED`` more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

# States: nothing yet, after system, after user, after assistant.  A conversation may end in 0 and 3.
_START = 0
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ROLE = {2: "user", 3: "assistant"}  # what a state's insertion or new role is called
_ASKS = {0: 2, 1: 2, 2: 3, 3: 2}  # the state that inserting leads to

# A row's mark: its role's initial, and its faults.
_INITIALS = "sua"
_CUT, _BLANK, _SEEN = 4, 8, 16

_WHITE = b" \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


def _inserting(v: list[int]) -> list[int]:
    for _ in range(2):  # two insertions lead from any state to an accepting one
        v = [min(c, INSERT + v[_ASKS[s]]) for s, c in enumerate(v)]
    return v


#: Costs at the end of a conversation; the speculative vector treats all states alike.
END: Vector = tuple(_inserting([0, 99, 99, 0]))  # type: ignore[assignment]
SPECULATIVE: Vector = (0, 0, 0, 0)


class Viterbi:
    """Backward steps and the choices they imply, each worked out once for a pair of vector and mark."""

    def __init__(self):
        self._steps: dict[tuple[Vector, int], tuple[Vector, list[tuple[str, int, int]]]] = {}

    def step(self, after: Vector, mark: int) -> tuple[Vector, list[tuple[str, int, int]]]:
        """The vector before a row, less its least entry, and for each state (edits, next state, cost)."""
        key = (after, mark)
        if key not in self._steps:
            self._steps[key] = self._work_out(after, mark)
        return self._steps[key]

    def _work_out(self, after: Vector, mark: int):
        extra = TRUNCATED if mark & _CUT else 0
        kept = _NEXT.get(_INITIALS[mark & 3] if mark & 3 < 3 else "", {})
        moves: list[list[tuple[str, int, int]]] = []  # ASCII order
        for s in range(4):
            here = [("D", s, DELETE)]
            if not mark & (_BLANK | _SEEN):
                if s in kept:
                    here.append(("K", kept[s], extra))
                here.append(("R", _ASKS[s], REROLE + extra))
            moves.append(here)
        v = _inserting([min(cost + after[to] for _, to, cost in here) for here in moves])
        chosen = []
        for s in range(4):
            edits, cost, at = "", 0, s
            while True:
                options = [*moves[at], ("I", _ASKS[at], INSERT)]
                ends = {"I": v}
                best = min((e, to, c) for e, to, c in options if c + ends.get(e, after)[to] == v[at])
                edits, cost, at = edits + best[0], cost + best[2], best[1]
                if best[0] != "I":
                    break
            chosen.append((edits, at, cost))
        least = min(v)
        return tuple(c - least for c in v), chosen

    def back(self, marks: bytes, right: Vector) -> Vector:
        """The vector at a chunk's left end."""
        for m in reversed(marks):
            right = self.step(right, m)[0]
        return right

    def fixed(self, marks: bytes, old: Vector, new: Vector) -> bool:
        """Whether a chunk's left end stays as it is when its right end changes from ``old`` to ``new``."""
        for m in reversed(marks):
            if old == new:
                return True
            old, new = self.step(old, m)[0], self.step(new, m)[0]
        return old == new

    def walk(self, marks: bytes, right: Vector, state: int) -> tuple[list[str], int, int]:
        """Edits of each row of a chunk, the state behind it, and what they cost."""
        choices = []
        for m in reversed(marks):
            right, choice = self.step(right, m)
            choices.append(choice)
        edits, cost = [], 0
        for choice in reversed(choices):
            e, state, c = choice[state]
            edits.append(e)
            cost += c
        return edits, state, cost


def mark_of(role: str, text: bytes) -> int:
    mark = _INITIALS.find(role[:1]) if role[:1] else 3
    mark = 3 if mark < 0 else mark
    shown = text.rstrip(_WHITE)
    return mark | (_BLANK if not shown else 0 if shown[-1:] in (b".", b"!", b"?") else _CUT)


def print_of(role: str, text: bytes) -> bytes:
    """A digest that rows of equal role and text share."""
    return hashlib.blake2b(role.encode() + b"\0" + text, digest_size=16).digest()


class Repair:
    """A conversation read in order, chunk by chunk, into one result."""

    def __init__(self, machine: Viterbi):
        self.machine = machine
        self.state, self.cost = _START, 0
        self.faults = [0, 0, 0]
        self.illegal, self.last = 0, None
        self.turns = [None, None, 0]  # least, greatest, distinct
        self.audit: list[str] = []
        self.sha, self.first = hashlib.sha256(), True

    def chunk(self, marks: bytes, right: Vector, turns: list[int | None], roles: list[str], texts: list[bytes]) -> None:
        edits, after, cost = self.machine.walk(marks, right, self.state)
        for m, turn, role, text, edit in zip(marks, turns, roles, texts, edits, strict=True):
            if m & (_BLANK | _SEEN | _CUT):
                self.faults[0 if m & _BLANK else 1 if m & _SEEN else 2] += 1
            if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.last = role[:1]
            if turn is not None:
                if self.turns[1] != turn:
                    self.turns[2] += 1
                self.turns[:2] = [turn if self.turns[0] is None else self.turns[0], turn]
            for e in edit:
                if e == "D":
                    continue
                self.state = _NEXT[role[0]][self.state] if e == "K" else _ASKS[self.state]
                self._line(role if e == "K" else _ROLE[self.state], b"" if e == "I" else text)
        self.audit += edits
        self.cost += cost
        assert self.state == after

    def _line(self, role: str, text: bytes) -> None:
        self.sha.update(b"" if self.first else b"\n")
        self.sha.update(role.encode() + b":")
        self.sha.update(text)
        self.first = False

    def result(self) -> dict:
        while self.state not in (0, 3):
            self.audit.append("I")
            self.cost += INSERT
            self.state = _ASKS[self.state]
            self._line(_ROLE[self.state], b"")
        least, most, distinct = self.turns
        return {
            "gaps": 0 if least is None else most - least + 1 - distinct, "blank": self.faults[0], "duplicate": self.faults[1], "truncated": self.faults[2],
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest(),
        }


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_ARROW = pa.struct([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _RESULT.split(", ")])
_CHUNK = "part int, k int, marks binary, prints binary, turns array<long>, roles array<string>, texts array<binary>"
_CHUNK_ARROW = pa.struct(
    [("part", pa.int32()), ("k", pa.int32()), ("marks", pa.binary()), ("prints", pa.binary()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.binary()))]
)


def _seen(prints: list[bytes]) -> list[bool]:
    before: set[bytes] = set()
    return [p in before or before.add(p) is not None for p in prints]


class _Open:
    """The rows of a conversation since its last chunk."""

    def __init__(self, conv: int | None):
        self.conv, self.cut = conv, False
        self.clear()

    def clear(self) -> None:
        self.turns, self.roles, self.texts, self.size = [], [], [], 0

    def add(self, turn: int | None, role: str, text: bytes) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    def full(self, rows: int) -> bool:
        return len(self.turns) >= rows or self.size >= CHUNK_BYTES

    def rows(self) -> tuple[bytes, list[bytes]]:
        pairs = list(zip(self.roles, self.texts, strict=True))
        return bytes(mark_of(r, t) for r, t in pairs), [print_of(r, t) for r, t in pairs]


def _first_pass(chunk_rows: int):
    """Conversations that a sorted partition holds whole are finished in it; of others the chunks are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, part = Viterbi(), TaskContext.get().partitionId()
        out: list[tuple[int | None, dict | None, dict | None]] = []
        held, k, size = None, 0, 0

        def close(whole: bool) -> None:
            nonlocal k, size
            marks, prints = held.rows()
            size += held.size
            if whole:
                marks = bytes(m | (_SEEN if s else 0) for m, s in zip(marks, _seen(prints), strict=True))
                repair = Repair(machine)
                repair.chunk(marks, END, held.turns, held.roles, held.texts)
                out.append((held.conv, repair.result(), None))
            else:
                chunk = {"part": part, "k": k, "marks": marks, "prints": b"".join(prints), "turns": held.turns, "roles": held.roles, "texts": held.texts}
                out.append((held.conv, None, chunk))
                k += 1

        def ready() -> pa.RecordBatch:
            nonlocal size
            conv, result, chunk = zip(*out, strict=True)
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(result, _RESULT_ARROW), pa.array(chunk, _CHUNK_ARROW)], names=["conv_id", "result", "chunk"])

        first = True
        for batch in batches:
            for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or conv != held.conv:
                    if held is not None:
                        close(not (first or held.cut))
                        first = False
                    held = _Open(conv)
                elif held.full(chunk_rows):
                    close(False)
                    held.cut = True
                    held.clear()
                if not gone:
                    held.add(turn, role, text)
                if size >= CHUNK_BYTES or len(out) >= chunk_rows:
                    yield ready()
        if held is not None:
            close(False)
            yield ready()

    return run


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for conv, gid, prints in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            halves = np.frombuffer(prints, np.int64).reshape(-1, 2)
            n = len(halves)
            arrays = [pa.array([conv] * n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.full(n, gid)), pa.array(np.arange(n, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "p1", "p2", "gid", "i"])


_STATE = "conv_id long, gid long, marks binary, right_v array<long>, left_v array<long>, moved boolean"


def _rows_out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _STATE.split(", ")])


def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = Viterbi()
    for batch in batches:
        rows = []
        for conv, gid, marks, firsts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            once = set(firsts or ())
            marks = bytes(m if i in once else m | _SEEN for i, m in enumerate(marks))
            right = END if ends else SPECULATIVE
            rows.append((conv, gid, marks, right, machine.back(marks, right), True))
        if rows:
            yield _rows_out(rows)


def _fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs down blocks of chunks, each block from its last chunk to its first."""
    machine = Viterbi()
    right_of = (None, None, None)  # conversation, number and vector of the chunk just fixed
    for batch in batches:
        rows = []
        for conv, gid, marks, old, left, _, next_left, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            old, left = tuple(old), tuple(left)
            new = right_of[2] if right_of[:2] == (conv, gid + 1) else tuple(next_left) if next_left else END
            moved = not machine.fixed(marks, old, new)
            left = machine.back(marks, new) if moved else left
            right_of = (conv, gid, left)
            rows.append((conv, gid, marks, new, left, moved))
        if rows:
            yield _rows_out(rows)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the chunks of each conversation in order: costs first, then rows."""
    machine = Viterbi()
    repair, conv, costs = None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([repair.result()], _RESULT_ARROW)], names=["conv_id", "result"])

    for batch in batches:
        for c, _, kind, marks, right, turns, roles, texts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if repair is None or c != conv:
                if repair is not None:
                    yield out()
                repair, conv = Repair(machine), c
            if kind == 0:
                costs = (marks, tuple(right))
            else:
                repair.chunk(*costs, turns, roles, texts)
    if repair is not None:
        yield out()


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)``: rows damaged by crc32(``conv_id:turn``) mod 20; nulls read as one space.

    0 marks the row as gone, 1 empties its text, 2 removes its ``.!?``, 3
    repeats it, 4 makes its role user.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("harm"),
    )
    harm = F.col("harm")
    text = F.when(harm == 1, "").when(harm == 2, F.translate("text", ".!?", "")).when(harm != 0, F.col("text"))
    copies = F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (harm == 0).alias("gone"), copies.alias("copy")).drop("copy")


def repaired(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Faults and cheapest repair of each conversation in ``rows`` (conv_id, turn, role, text, gone).

    Rows of a conversation go by turn, null first, then by role, the first 64
    characters of the text, and a hash of it.  Rows that are gone count for
    nothing; a conversation without others has zeros, an empty audit and the
    hash of nothing.  A null conv_id is a conversation.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "start", "same"]
    keyed = bound_batches(rows).withColumns({"start": F.substring("text", 1, 64), "same": F.xxhash64("text")})
    # Equal rows are told apart, so that ever so many can be dealt to several partitions.
    spread = keyed.withColumn("lot", F.monotonically_increasing_id()).repartitionByRange(*order, "lot").sortWithinPartitions(*order)
    plain = spread.select("conv_id", "turn", "role", F.encode("text", "UTF-8").alias("text"), "gone")
    read = scratch.write(plain.mapInArrow(_first_pass(chunk_rows), f"conv_id long, result struct<{_RESULT}>, chunk struct<{_CHUNK}>"))
    whole = read.filter("result is not null").select("conv_id", "result.*")

    cut = read.filter("chunk is not null")
    # One number for each partition of the sort.
    of_part = sorted(cut.groupBy("chunk.part").agg(F.count(F.lit(1))).collect())
    starts = list(zip([p for p, _ in of_part], np.cumsum([0, *(n for _, n in of_part)]).tolist(), strict=False))
    if not starts:
        return whole
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start long"))
    numbered = cut.select("conv_id", "chunk.*").join(start, "part").withColumn("gid", F.col("start") + F.col("k"))
    light = scratch.write(numbered.select("conv_id", "gid", "marks", "prints"))

    places = light.select("conv_id", "gid", "prints").mapInArrow(_prints, "conv_id long, p1 long, p2 long, gid long, i int")
    firsts = places.groupBy("conv_id", "p1", "p2").agg(F.min(F.struct("gid", "i")).alias("at"))
    firsts = firsts.groupBy(F.col("at.gid").alias("gid")).agg(F.collect_list("at.i").alias("firsts"))
    after = light.select((F.col("gid") - 1).alias("gid"), F.struct("conv_id").alias("next"))
    ends = F.col("next").isNull() | ~F.col("conv_id").eqNullSafe(F.col("next.conv_id"))
    told = light.join(firsts, "gid", "left").join(after, "gid", "left").select("conv_id", "gid", "marks", "firsts", ends.alias("ends"))
    state = scratch.write(told.mapInArrow(_speculate, _STATE))
    reach = 0
    while not state.filter("moved").isEmpty():
        reach += 1
        after = state.select((F.col("gid") - 1).alias("gid"), F.struct("conv_id", "left_v").alias("next"))
        next_left = F.when(F.col("conv_id").eqNullSafe(F.col("next.conv_id")), F.col("next.left_v"))
        block = F.shiftright("gid", reach)
        pairs = state.join(after, "gid", "left").select(*state.columns, next_left.alias("next_left"), block.alias("block"))
        fixed = scratch.write(pairs.repartition("block").sortWithinPartitions("block", F.desc("gid")).mapInArrow(_fix, _STATE))
        scratch.drop(state)
        state = fixed

    nothing = {"marks": F.lit(None).cast("binary"), "right_v": F.lit(None).cast("array<long>"), "turns": F.lit(None).cast("array<long>"), "roles": F.lit(None).cast("array<string>"), "texts": F.lit(None).cast("array<binary>")}
    columns = ["conv_id", "gid", "kind", *nothing]
    held = lambda df, kind, *own: df.withColumns({"kind": F.lit(kind)} | {c: e for c, e in nothing.items() if c not in own}).select(*columns)
    both = held(state, 0, "marks", "right_v").unionByName(held(numbered.drop("marks"), 1, "turns", "roles", "texts"))
    walked = both.repartition("conv_id").sortWithinPartitions("conv_id", "gid", "kind").mapInArrow(_stitch, f"conv_id long, result struct<{_RESULT}>")
    return whole.unionByName(walked.select("conv_id", "result.*"))


def repair_conversations(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """:func:`repaired` over :func:`damaged`, one row for each conv_id; needs conv_id, turn, role and text, and ignores others.

    Repeated rows are duplicates like any other; an empty table gives an empty one.
    """
    return repaired(damaged(conversations), chunk_rows)
