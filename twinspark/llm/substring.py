"""Substring dedup by hashing of lines or paragraphs, and of the sentences in them.

Texts are cut into units; a unit is normalised (lower-cased, runs of ASCII white space made one blank, ends trimmed)
and digested; the occurrence with the least (doc_id, start) of each digest stays and the others go, with their offsets
in the original text. Units of fewer than `min_words` words stay: they repeat by chance.

The default unit is a line. Passages that repeat often begin and end within a line, so a line is also cut into sentences,
and a sentence of more than `LONG` words at words that its words alone decide (`cuts`): a passage inside it is cut alike
wherever it stands. A line of one piece is one unit. What goes is the union of the units' spans.

Digests are counted and ranked by an aggregate that sums up before it shuffles; only digests that occur twice or more
meet their occurrences, in a join of two exchanges whose skewed side Spark splits. So a line that most documents have
costs no more than its rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.sources.written import materialize

MIN_WORDS = 8
LINES, PARAGRAPHS = r"\n", r"\n[^\S\n]*\n\s*"
#: Where a unit is cut further.
SENTENCES = r"\n|(?<=[.!?])[ \t\f\r]"
#: Units of more words are cut further; so many words on both sides take part in the choice of a cut.
LONG, NEAR = 40, 7
_UNITS = "doc_id long, row long, start long, stop long, d0 long, d1 long"


_WORD = re.compile(r"[^ \t\n\r\f\v]+")


def cuts(words: list[str]) -> list[int]:
    """Words before which to cut: those whose hash (of the word and the next) is the only least among NEAR on both sides."""
    h = [md5(f"{a} {b}".encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:4] for a, b in zip(words, words[1:])]
    return [i for i in range(NEAR, len(h) - NEAR) if all(h[i] < h[j] for j in range(i - NEAR, i + NEAR + 1) if j != i)]


def units(text: str | None, separator: re.Pattern, min_words: int, long: int = LONG) -> Iterator[tuple[int, int, bytes]]:
    """(start, stop, normalised unit) of the units that have `min_words` words."""
    at, text = 0, text or ""
    for m in [*separator.finditer(text), None]:
        stop = m.start() if m else len(text)
        words = text[at:stop].lower().encode("utf-8", "surrogatepass").split()
        if len(words) > long > 0:
            place = [w.start() for w in _WORD.finditer(text, at, stop)]
            edge = [0, *cuts([w.decode("utf-8", "surrogatepass") for w in words]), len(words)]
            for a, b in zip(edge, edge[1:]):
                if b - a >= max(1, min_words):
                    yield (place[a] if a else at), (place[b] if b < len(words) else stop), b" ".join(words[a:b])
        elif len(words) >= max(1, min_words):
            yield at, stop, b" ".join(words)
        at = m.end() if m else stop


def nested_units(text: str | None, separator: re.Pattern, inner: re.Pattern, min_words: int, long: int = LONG) -> Iterator[tuple[int, int, bytes]]:
    """`units` by `separator`, and the pieces of those that `inner` and `long` cut into more than one; of one piece, the piece."""
    pieces = list(units(text, inner, 1, long))
    at = 0
    for start, stop, unit in units(text, separator, 1, 0):
        to = at
        while to < len(pieces) and pieces[to][0] < stop:
            to += 1
        found = pieces[at:to] + ([(start, stop, unit)] if to - at > 1 else [])
        at = to
        yield from (u for u in found if u[2].count(b" ") + 1 >= min_words)


def unit_table(df: DataFrame, id_col: str, text_col: str, separator: str, inner: str | None, min_words: int, long: int) -> DataFrame:
    """A row for each unit: doc_id, start and stop in characters, 128-bit digest (d0, d1); `row` is a number of its own for
    each unit, steady only once the table is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, within = re.compile(separator), inner and re.compile(inner)
        names = [x.split()[0] for x in _UNITS.split(", ")]

        def flush() -> pa.RecordBatch:
            two = np.frombuffer(b"".join(digests), dtype=">i8").astype("<i8").reshape(-1, 2)
            cols = list(zip(*out)) or [()] * 4
            out.clear(), digests.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(two[:, 0]), pa.array(two[:, 1])], names)

        out, digests, row = [], [], TaskContext.get().partitionId() << 40
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                for start, stop, unit in nested_units(text, pattern, within, min_words, long) if within else units(text, pattern, min_words, long):
                    row += 1
                    out.append((doc_id, row, start, stop))
                    digests.append(md5(unit, usedforsecurity=False).digest())
                if len(out) >= 20_000:
                    yield flush()
        yield flush()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _UNITS)


def repeated_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = LINES, inner: str | None = SENTENCES, min_words: int = MIN_WORDS, long: int = LONG) -> DataFrame:
    """A row for each unit to remove: doc_id, start, stop (characters), digest, occurrences, and the kept occurrence's
    kept_doc_id and kept_start.

    `inner` None leaves units uncut, `long` 0 leaves long ones whole; units and their pieces overlap. Null and empty texts
    have no units; whole texts are read, however long; other columns aren't read. A null id ranks after all others. Where (doc_id, start) ties (rows that share an
    id), all but one go, so the result always holds one row less than occurrences for each digest. An empty table gives no
    rows.
    """
    table = materialize(unit_table(df, id_col, text_col, separator, inner, min_words, long), "units")
    # counts alone are hashed, not sorted; most digests occur once and go no further
    twice = materialize(table.groupBy("d0", "d1").agg(F.count("*").alias("occurrences")).where("occurrences > 1"), "twice")
    hits = materialize(table.join(twice, ["d0", "d1"]), "hits")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "row")
    # written, so that the join below is of two exchanges, of which Spark splits skewed ones
    kept = materialize(hits.groupBy("d0", "d1").agg(F.min(rank).alias("kept")), "kept")
    out = hits.join(kept, ["d0", "d1"]).where("row <> kept.row")
    digest = F.lower(F.concat(F.lpad(F.hex("d0"), 16, "0"), F.lpad(F.hex("d1"), 16, "0")))
    return out.select("doc_id", "start", "stop", digest.alias("digest"), "occurrences", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))


def removed_spans(removed: DataFrame) -> DataFrame:
    """doc_id and spans (pairs of start and stop, sorted; they may overlap) of `repeated_units`: what to cut out of each text."""
    return removed.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def cut(text: str, spans: list) -> str:
    """`text` without `spans` (sorted)."""
    out, at = [], 0
    for start, stop in spans:
        out.append(text[at:start])
        at = max(at, stop)
    return "".join([*out, text[at:]])
