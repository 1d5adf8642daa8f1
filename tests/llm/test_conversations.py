import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from pedshade.llm import conversations as c

CONVERSATIONS = "conv_id long, turn long, role string, text string"
sys.setrecursionlimit(20_000)  # for brute()
WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """The contract by plain recursion over edits and whole audits."""
    by: dict = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = by.setdefault(conv, [])
        text = "" if harm == 1 else text.translate({ord(x): None for x in ".!?"}) if harm == 2 else text
        role = "user" if harm == 4 else role
        held += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = {}
    for conv, held in by.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in held:
            shown = text.rstrip(WHITE)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        n = len(held)

        @lru_cache(None)
        def best(i, s, inserts):
            found = [(0, "", ())] if i == n and s in ("", "a") else []
            wants = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
            name = {"u": "user", "a": "assistant"}[wants]
            def go(cost, letter, to, line, at, k):
                rest = best(at, to, k)
                if rest:
                    found.append((cost + rest[0], letter + rest[1], (*line, *rest[2])))
            if inserts < 3:
                go(3, "I", wants, (f"{name}:",), i, inserts + 1)
            if i < n:
                _, role, text = held[i]
                go(4, "D", s, (), i + 1, 0)
                extra = 3 if faults[i] == "truncated" else 0
                if faults[i] not in ("blank", "duplicate"):
                    go(3 + extra, "R", wants, (f"{name}:{text}",), i + 1, 0)
                    if role[:1] == wants or (role[:1] == "s" and s == ""):
                        go(extra, "K", role[:1], (f"{role}:{text}",), i + 1, 0)
            return min(found) if found else None

        cost, audit, lines = best(0, "", 0)
        turns = [t for t, *_ in held if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def plain(df):
    rows = df.collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def made(seed, convs=40, longest=14):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No", "Why?", " ", "", None, f"t{turn}.", f"t{turn} é!"])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += rows[:5]
    rnd.shuffle(rows)
    return rows


def clashing(df):
    return df.withColumns({k: F.lit(1) for k in ("part", "k", "gid", "marks", "kind", "result", "lot", "start", "same", "gone")})


@pytest.mark.parametrize("chunk_rows", [2, 5, 4096])
def test_repair_against_recursion(spark, chunk_rows):
    rows = made(chunk_rows)
    df = clashing(spark.createDataFrame(rows, CONVERSATIONS).repartition(3))
    assert plain(c.repair_conversations(df, chunk_rows)) == brute(rows)


def test_one_long_conversation_in_many_chunks(spark):
    rnd = random.Random(3)
    rows = [(7, t, rnd.choice(["user", "assistant"]), rnd.choice(["a.", "b", f"c{t}."])) for t in range(180)]
    rows += [(8, t, "tool", f"x{t}.") for t in range(90)]  # vectors that never meet
    rows += [(9, 5, "user", "Same.")] * 90
    rows += [(10, t, ["user", "assistant"][t % 2], f"d{t}.") for t in range(90)]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(4)
    assert plain(c.repair_conversations(df, 4)) == brute(rows)


def test_all_rows_gone_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], CONVERSATIONS)
    assert plain(c.repair_conversations(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert c.repair_conversations(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_long_texts(spark):
    rows = [(1, 0, "user", "word " * 2_000_000 + "end."), (1, 1, "assistant", "Yes."), (2, 0, "user", "No."), (2, 1, "assistant", "x" * 5_000_000 + "?")]
    assert plain(c.repair_conversations(spark.createDataFrame(rows, CONVERSATIONS))) == brute(rows)


def test_vectors_that_meet_end_a_fix():
    machine = c.Viterbi()
    marks = bytes([1, 2] * 50)
    assert machine.fixed(marks, c.END, c.SPECULATIVE)
    assert not machine.fixed(bytes([8] * 50), c.END, c.SPECULATIVE)  # deletions leave vectors as they are
    assert machine.back(bytes([8] * 50), c.END) == c.END
