import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from twinspark.llm.conversations import GOAL, damaged, distances, edited, repair, summary, walk

NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def brute(rows):
    """rows: (conv_id, turn, role, text), damaged here. By recursion over rows and states, each time over all edits."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            told = lambda v: " " if v is None else str(v)
            role, text = told(role), told(text)
            h = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
            text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
            kept += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in kept:
            ink = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not ink else 2 if (role, text) in seen else 3 if ink[-1] not in ".!?" else 0)
            seen.add((role, text))

        @lru_cache(None)
        def best(i, told, inserts):
            """Least (cost, audit) and the lines from row i on; told: the initials so far, shortened."""
            options = [(0, "", ())] if i == len(kept) and told in ("", "a") else []
            nxt = "a" if told == "u" else "u"
            name = {"u": "user", "a": "assistant"}
            add = lambda cost, letter, line, rest: options.append((cost + rest[0], letter + rest[1], line + rest[2]))
            if inserts < 3:
                add(2, "I", (f"{name[nxt]}:",), best(i, nxt, inserts + 1))
            if i < len(kept):
                _, role, text = kept[i]
                add(3, "D", (), best(i + 1, told, 0))
                if faults[i] in (0, 3):
                    if role[:1] == nxt or (role[:1] == "s" and told == ""):
                        add(faults[i] == 3, "K", (f"{role}:{text}",), best(i + 1, role[:1], 0))
                    add(2 + (faults[i] == 3), "R", (f"{name[nxt]}:{text}",), best(i + 1, nxt, 0))
            return min(options) if options else (10**9, "", ())

        cost, audit, lines = best(0, "", 0)
        turns = [t for t, _, _ in kept if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), int(cost), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(5)
    texts = ["", " \t", "ok.", "so it is!", "cut of", "why? ", "é…", None, "x" * 3000 + "."]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn + rng.choice((0, 0, 0, 2)), rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None)), rng.choice(texts)))
    rows += [(100, t, ("user", "assistant")[t % 2] if t % 7 else "system", rng.choice(texts + [f"{t}." for _ in range(9)])) for t in range(150)]
    rows += [(101, None, "user", "hello."), (101, None, "user", "hello."), (101, 4, "assistant", "yes."), (None, 1, "user", "hi."), (None, None, "assistant", "ho.")]
    rows += [(102, 3, "user", "again.")] * 90 + [(103, 9, "user", "say it.")] * 2
    return rows


@pytest.mark.parametrize("part_rows", [4096, 7, 1])
def test_equals_brute_force(spark, part_rows):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, `a.b` string").repartition(5)
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in summary(repair(damaged(df), part_rows=part_rows)).collect()}
    assert got == brute(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert summary(repair(damaged(empty))).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"a:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([("a", gone, "user", "hi.")], empty.schema)
    assert [tuple(r) for r in summary(repair(damaged(df))).select("conv_id", *NAMES).collect()] == [("a", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_messages_of_a_walk():
    rows = [(0, "system"), (0, "assistant"), (3, "user"), (1, "user")]
    dist = distances(rows, GOAL)
    # keeping the cut row, deleting the blank one and adding an answer (KIKKDI) costs 8 as well
    audit = walk(rows, dist, 0)
    assert (dist[0], audit) == (8, "KIKDD")
    said = [(role, str(i)) for i, (_, role) in enumerate(rows)]
    assert edited(said, audit, 0) == [("system", "0"), ("user", ""), ("assistant", "1")]
