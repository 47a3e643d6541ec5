"""Repair of a conversation's structure by cheapest edits.

A conversation should run `(system)? (user assistant)*`. Edits are arcs between nodes (rows consumed, role told last): keep a
row, change its role, delete it, insert an empty one. Costs are small integers, so shortest distances to the goal come from
Dial's queue: a ring of as many buckets as an arc can cost. The distances recorded, the audit is a walk from the start along
tight arcs that takes the least letter each time.

Rows are dealt by ranges of (conversation, turn, role, text), so that no conversation has to fit one task. A task cuts its
rows into parts of at most `PART_ROWS` rows; a conversation that lies whole in one part, as nearly all do, is solved there.
For the others each part is solved from every role to every role, the parts' costs and audits (no texts) are put together a
conversation at a time, and each part is edited by its share of the audit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from twinspark.sources.written import materialize

#: Rows and characters of a part, at most (a part has one row at least).
PART_ROWS = 4096
PART_CHARS = 4 << 20
#: Costs of edits; what a truncated row adds if it stays.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
RING = 1 + max(DELETE, INSERT, RENAME + TRUNCATED)
FAR = 1 << 40
#: States: nothing told yet, system, user, assistant told last. The role that has to follow, and who may stand before.
FOLLOWS = (2, 2, 3, 2)
BEFORE = {1: (0,), 2: (0, 1, 3), 3: (2,)}
LANDS = {"s": 1, "u": 2, "a": 3}
ROLES = {2: "user", 3: "assistant"}
GOAL = (0, FAR, FAR, 0)
LEGAL = {"su", "ua", "au"}
SOUND, BLANK, DUPLICATE, CUT = range(4)
INK = re.compile(r"[^\x20\x09-\x0D]")

_MESSAGES = "array<struct<role:string,text:string>>"
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_RESULT = f"part long, parts long, {_COUNTS}, audit string, repaired {_MESSAGES}"


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv_id, turn, role, text and copies: rows damaged by crc32(`conv_id:turn`) % 20.

    0 drops a row (copies is 0, the rest null), 1 empties its text, 2 removes its full stops, exclamation and question marks,
    3 repeats it, 4 makes its role `user`. A null counts as one space, but in `turn` itself.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text(conv), F.lit(":"), text(turn)).cast("binary")) % 20
    kept = lambda c: F.when(kind != 0, c)
    said = F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    return df.select(
        F.col(conv).alias("conv_id"), kept(F.col(turn)).alias("turn"), kept(F.when(kind == 4, "user").otherwise(text("role"))).alias("role"), kept(said).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def distances(rows: list[tuple[int, str]], ends: tuple[int, ...]) -> list[int]:
    """Least cost from each node 4 * i + state to the goal; rows are (fault, role), a goal is a state with 0 in `ends`."""
    dist, done = [FAR] * (4 * len(rows) + 4), bytearray(4 * len(rows) + 4)
    ring: list[list[int]] = [[] for _ in range(RING)]
    for t, c in enumerate(ends):
        if c == 0:
            dist[4 * len(rows) + t] = 0
            ring[0].append(4 * len(rows) + t)
    d, waiting = 0, len(ring[0])
    while waiting:
        bucket = ring[d % RING]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if done[node]:
                continue
            done[node] = 1
            i, t = divmod(node, 4)
            arcs = [(4 * i + s, INSERT) for s in BEFORE.get(t, ()) if t != 1]
            if i:
                fault, role = rows[i - 1]
                arcs.append((node - 4, DELETE))
                if fault not in (BLANK, DUPLICATE):
                    more = TRUNCATED if fault == CUT else 0
                    arcs += [(4 * i - 4 + s, RENAME + more) for s in BEFORE.get(t, ()) if t != 1]
                    if LANDS.get(role[:1]) == t:
                        arcs += [(4 * i - 4 + s, more) for s in BEFORE[t]]
            for source, cost in arcs:
                if d + cost < dist[source]:
                    dist[source] = d + cost
                    ring[(d + cost) % RING].append(source)
                    waiting += 1
        d += 1
    return dist


def walk(rows: list[tuple[int, str]], dist: list[int], state: int) -> str | None:
    """The least audit (letters D, I, K, R) from a state before the first row along tight arcs; None if there is no way."""
    i, out, d = 0, [], dist[state]
    if d >= FAR:
        return None
    while i < len(rows) or d:
        here, ahead, follows = 4 * i, 4 * i + 4, FOLLOWS[state]
        fault, role = rows[i] if i < len(rows) else (BLANK, "")
        more = TRUNCATED if fault == CUT else 0
        lands = LANDS.get(role[:1])
        stays = i < len(rows) and fault not in (BLANK, DUPLICATE)
        if i < len(rows) and dist[ahead + state] + DELETE == d:
            letter, i = "D", i + 1
        elif dist[here + follows] + INSERT == d:
            letter, state = "I", follows
        elif stays and lands and state in BEFORE[lands] and dist[ahead + lands] + more == d:
            letter, i, state = "K", i + 1, lands
        else:
            letter, i, state = "R", i + 1, follows
        out.append(letter)
        d = dist[4 * i + state]
    return "".join(out)


def edited(rows: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """(role, text) of the rows after the edits of an audit."""
    out, rest = [], iter(rows)
    for letter in audit:
        role, text = next(rest) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter == "K":
            state = LANDS[role[:1]]
        else:
            state = FOLLOWS[state]
            role = ROLES[state]
        out.append((role, text))
    return out


def _fault(text: str) -> int:
    """Blank, truncated or sound; a row is looked at alone."""
    last = INK.search(text[::-1])
    return BLANK if not last else SOUND if last[0] in ".!?" else CUT


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one: a row that a share of the table repeats leaves a task a few times."""
    for b in batches:
        keys = ["conv_id", "turn", "role", "text"]
        t = pa.Table.from_batches([b]).group_by(keys).aggregate([("copies", "sum")]).rename_columns([*keys, "copies"])
        yield from t.select(b.schema.names).cast(b.schema).to_batches()


class _Part:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv, part: int):
        self.conv, self.part = conv, part
        self.rows: list[list] = []  # role, text, fault
        self.turns: list[int | None] = []
        self.chars, self.seen = 0, {}

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        fault, key = _fault(text), (role, text)
        if fault != BLANK and (again or key in self.seen):
            fault = DUPLICATE
        elif fault != BLANK:
            self.seen[key] = len(self.rows)
        if fault in (BLANK, DUPLICATE):
            text = ""  # it can only be deleted
        self.rows.append([role, text, fault])
        self.turns.append(turn)
        self.chars += len(text)

    def steps(self) -> list[tuple[int, str]]:
        return [(fault, role) for role, _, fault in self.rows]

    def counts(self) -> dict:
        """The numbers of the part by itself."""
        told = [t for t in self.turns if t is not None]
        initials = [role[:1] for role, _, _ in self.rows]
        faults = [f for _, _, f in self.rows]
        return {
            "gaps": told[-1] - told[0] + 1 - len(set(told)) if told else 0, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        }

    def solved(self) -> dict:
        steps = self.steps()
        dist = distances(steps, GOAL)
        audit = walk(steps, dist, 0)
        messages = edited([(role, text) for role, text, _ in self.rows], audit, 0)
        return {"conv_id": self.conv, "part": 0, "parts": 1, **self.counts(), "cost": dist[0], "audit": audit, "repaired": [{"role": r, "text": t} for r, t in messages]}

    def open(self) -> dict:
        """As it is, for a conversation that has other parts or may have them."""
        told = [t for t in self.turns if t is not None]
        digest = lambda k: hashlib.md5(f"{len(k[0])}:{k[0]}{k[1]}".encode()).hexdigest()
        firsts = [{"row": i, "digest": digest(k)} for k, i in self.seen.items()]
        rows = [{"role": r, "text": t, "fault": f} for r, t, f in self.rows]
        return {"conv_id": self.conv, "part": self.part, "rows": rows, "firsts": firsts, "first_turn": told[0] if told else None, "last_turn": told[-1] if told else None, **self.counts()}


def _cutter(schema: pa.Schema, part_rows: int, part_chars: int):
    """Sorted rows of a task as solved conversations and, of those that may go on in another task, as open parts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, out, part, last = TaskContext.get().partitionId(), 0, [], None, None
        opened = True  # the task's first conversation may have begun in another
        for b in batches:
            for r in b.to_pylist():
                if part is None or r["conv_id"] != part.conv:
                    if part is not None:
                        out.append(part.open() if opened else part.solved())
                        opened = False
                    part, last = _Part(r["conv_id"], (task << 32) + (n := n + 1)), None
                key = (r["turn"], r["role"], r["text"])
                for _ in range(r["copies"]):
                    if part.rows and (len(part.rows) >= part_rows or part.chars + len(r["text"]) > part_chars):
                        out.append(part.open())
                        part, opened = _Part(r["conv_id"], (task << 32) + (n := n + 1)), True
                    part.add(*key, again=key == last)
                    last = key
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
        if part is not None:
            out.append(part.open())
        yield pa.RecordBatch.from_pylist(out, schema)

    return cut


def _arrow(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def repair(df: DataFrame, part_rows: int = PART_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """Of a table with conv_id, turn, role, text and copies (how often the row stands there; 0 only names the conversation):
    conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (roles and texts).

    A conversation gives one row, or several parts in order if it is long (`part_rows`, `part_chars`) or lies in two tasks; numbers are
    then to be added up, audits and messages put one after the other. Rows go by turn (nulls first), role, text; copies
    stand together. The first fault of a row counts: blank (nothing but spaces), duplicate (same role and text before),
    truncated (no mark of an end). gaps counts the turns missing between the least and the greatest; illegal the neighbours
    whose initials aren't su, ua or au. Nulls in role or text count as one space, null ids are one conversation, an empty
    table gives none, a conversation without rows zeros and an empty audit. A text stands in memory whole; other columns
    aren't read. The audit of a conversation meets in one task, its texts don't.
    """
    text = lambda c: F.when(F.col("copies") > 0, F.coalesce(c, F.lit(" ")))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.col("copies").cast("long").alias("copies"))
    rows = rows.mapInArrow(_combined, rows.schema)
    # a prefix keeps the bounds of the ranges small, and texts of one prefix together
    ranged = rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {_RESULT}, rows array<struct<role:string,text:string,fault:int>>, firsts array<struct<row:int,digest:string>>, first_turn long, last_turn long"
    shape = StructType.fromDDL(schema)
    done = materialize(ranged.mapInArrow(_cutter(_arrow(shape), part_rows, part_chars), shape), "conversations")
    whole = done.where("parts = 1").select("conv_id", *[c.split()[0] for c in _RESULT.split(", ")])
    return whole.unionByName(_joined_parts(done.where("parts IS NULL").drop("parts", "cost", "audit", "repaired"), kind))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _joined_parts(parts: DataFrame, kind: str) -> DataFrame:
    """Results of the open parts."""
    # what a part saw first is a duplicate if an earlier part saw it; a part tells each message once
    told = parts.select("conv_id", "part", F.explode("firsts").alias("m")).select("conv_id", "part", "m.row", "m.digest")
    first = told.groupBy("conv_id", "digest").agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = told.alias("t").join(first.alias("f"), _same(F.col("t.conv_id"), F.col("f.conv_id")) & (F.col("t.digest") == F.col("f.digest")) & (F.col("t.part") > F.col("f.first")))
    again = again.groupBy(F.col("t.conv_id").alias("conv_id"), F.col("t.part").alias("part")).agg(F.collect_set("t.row").alias("again"))  # rows of one part
    marked = parts.drop("firsts").alias("p").join(again.alias("a"), _same(F.col("p.conv_id"), F.col("a.conv_id")) & (F.col("p.part") == F.col("a.part")), "left").select("p.*", "a.again")
    fault = lambda r, i: F.when(F.array_contains("again", i), DUPLICATE).otherwise(r["fault"])
    marked = marked.withColumn("rows", F.transform("rows", lambda r, i: F.struct(r["role"], r["text"], fault(r, i).alias("fault"))))
    marked = materialize(marked.drop("again", "blank", "duplicate", "truncated"), "parts")
    slim = f"conv_id {kind}, part long, costs array<long>, audits array<string>, head string, tail string, gaps long, illegal long, first_turn long, last_turn long, faults array<long>"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                steps = [(m["fault"], m["role"]) for m in r["rows"]]
                costs, audits = [FAR] * 16, [None] * 16
                for t in range(4):
                    dist = distances(steps, tuple(FAR * (s != t) for s in range(4)))
                    for s in range(4):
                        costs[4 * s + t], audits[4 * s + t] = dist[s], walk(steps, dist, s)
                ends = [m["role"][:1] for m in r["rows"]]
                row = {k: r[k] for k in ("conv_id", "part", "gaps", "illegal", "first_turn", "last_turn")}
                row |= {"costs": costs, "audits": audits, "head": ends[0] if ends else None, "tail": ends[-1] if ends else None, "faults": [[f for f, _ in steps].count(k) for k in (BLANK, DUPLICATE, CUT)]}
                yield pa.RecordBatch.from_pylist([row], solved)

    solved = _arrow(StructType.fromDDL(slim))
    share = f"conv_id {kind}, at long, state int, {_RESULT.replace(f', repaired {_MESSAGES}', '')}"
    to_share = _arrow(StructType.fromDDL(share))
    chosen = marked.mapInArrow(solve, slim).groupBy("conv_id").applyInArrow(lambda t: pa.Table.from_pylist(_chain(t.to_pylist()), to_share), share)
    both = marked.select("conv_id", "part", "rows").alias("m").join(chosen.alias("c"), _same(F.col("m.conv_id"), F.col("c.conv_id")) & (F.col("m.part") == F.col("c.at")))
    names = [c.split()[0] for c in _RESULT.split(", ")][:-1]
    result = f"conv_id {kind}, {_RESULT}"
    shape = _arrow(StructType.fromDDL(result))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                messages = edited([(m["role"], m["text"]) for m in r["rows"]], r["audit"], r["state"])
                row = {k: r[k] for k in ("conv_id", *names)} | {"repaired": [{"role": a, "text": t} for a, t in messages]}
                yield pa.RecordBatch.from_pylist([row], shape)

    return both.select("c.conv_id", "c.state", *[f"c.{n}" for n in names], "m.rows").mapInArrow(edit, result)


def _chain(parts: list[dict]) -> list[dict]:
    """Each part's share of the audit. A row a part: a conversation of n rows has about n / PART_ROWS of them."""
    parts.sort(key=lambda p: p["part"])
    goal, ahead = list(GOAL), [list(GOAL)]
    for p in parts[::-1]:
        goal = [min(p["costs"][4 * s + t] + goal[t] for t in range(4)) for s in range(4)]
        ahead.append(goal)
    ahead.reverse()
    state, out, tail, turn = 0, [], None, None
    for i, p in enumerate(parts):
        tight = [t for t in range(4) if p["costs"][4 * state + t] + ahead[i + 1][t] == ahead[i][state]]
        # where one audit begins another, the rest are inserts that the next part can make, so the shorter loses nothing
        audit, to = min((p["audits"][4 * state + t], t) for t in tight)
        gaps, illegal = p["gaps"], p["illegal"]
        if p["first_turn"] is not None:
            if turn is not None:
                gaps += max(p["first_turn"] - turn - 1, 0)
            turn = p["last_turn"]
        if p["head"] is not None:
            illegal += tail is not None and tail + p["head"] not in LEGAL
            tail = p["tail"]
        row = {"conv_id": p["conv_id"], "at": p["part"], "state": state, "part": i, "parts": len(parts), "gaps": gaps, "illegal": illegal, "cost": p["costs"][4 * state + to], "audit": audit}
        out.append(row | dict(zip(("blank", "duplicate", "truncated"), p["faults"])))
        state = to
    return out


def summary(repaired: DataFrame) -> DataFrame:
    """A row for each conversation: the numbers added up, the audit, and the sha256 of its `role:text` lines. A conversation
    of several parts passes a task part by part; its texts never stand in memory together."""
    lines = F.transform("repaired", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    numbers = [c.split()[0] for c in _COUNTS.split(", ")]
    one = repaired.where("parts = 1").select("conv_id", *numbers, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    many = repaired.where("parts > 1").select("conv_id", "part", *numbers, "audit", F.array_join(lines, "\n").alias("said"), (F.size("repaired") > 0).alias("any"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, sha, audits, begun = None, hashlib.sha256(), [], False

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row | {"audit": "".join(audits), "repaired_sha256": sha.hexdigest()}], shape)

        for b in batches:
            for r in b.to_pylist():
                if row is None or r["conv_id"] != row["conv_id"]:
                    if row is not None:
                        yield told()
                    row, sha, audits, begun = {"conv_id": r["conv_id"], **dict.fromkeys(numbers, 0)}, hashlib.sha256(), [], False
                row |= {n: row[n] + r[n] for n in numbers}
                audits.append(r["audit"])
                if r["any"]:
                    sha.update((("\n" if begun else "") + r["said"]).encode())
                    begun = True
        if row is not None:
            yield told()

    shape = _arrow(one.schema)
    return one.unionByName(many.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(fold, one.schema))
