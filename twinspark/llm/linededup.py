"""Line dedup by winnowing over line hashes.

Lines that aren't blank are normalised (lower-cased, runs of ASCII white space made one blank, ends trimmed) and hashed.
Of every `window` consecutive grams of `gram` lines the least hash (the rightmost of equal ones) is a fingerprint, so any
two runs of `gram + window - 1` equal lines have a fingerprint at the same place. Fingerprints that occur once are
dropped; around each of the others the match is extended both ways, to the runs of that guaranteed length that hold it,
which meet by digest. The run with the least (doc_id, line) stays, later ones go; runs that overlap or touch are
one longer run.

With `min_words`, a run of fewer lines is a match too where it holds so many words: such runs are too short to be
winnowed, so each is a fingerprint of its own. Text of scripts without blanks between words counts by its characters.

Digests are counted by an aggregate that sums up before it shuffles, and meet their places in a join of two exchanges,
which Spark splits where it is skewed; no pairs of places are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from twinspark.sources.written import materialize
from twinspark.llm.substring import LINES, units

GRAM, WINDOW = 2, 2
#: A name that no table has: it comes last and goes before the result.
RUNS = "runs of lines that go"
#: Characters of scripts that set no blanks between words (Thai to Burmese, Khmer, Chinese, Japanese); two count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _digest(lines: list[bytes]) -> int:
    return int.from_bytes(blake2b(b"\n".join(lines), digest_size=8).digest(), "little", signed=True)


def _wide(lines: list[bytes]) -> bytes:
    """Runs that meet by digest are deleted, so theirs has 128 bits."""
    return blake2b(b"\n".join(lines), digest_size=16).digest()


def winnow(hashes: list[int], window: int) -> list[int]:
    """Places of the least hash of each `window`, the rightmost of equal ones."""
    out, last = [], -1
    for i in range(len(hashes) - window + 1):
        at = min(range(i, i + window), key=lambda j: (hashes[j], -j))
        if at != last:
            out.append(at)
            last = at
    return out


def n_words(line: bytes) -> int:
    """Words of a normalised line."""
    n = line.count(b" ") + 1
    return n if line.isascii() else max(n, len(_UNSPACED.findall(line.decode("utf-8", "surrogatepass"))) // 2)


def short_runs(lines: list[bytes], length: int, min_words: int) -> Iterator[tuple[int, int]]:
    """(line, lines) of the runs of less than `length` lines that hold `min_words` words. A longer run is left out where
    each of its lines is a run by itself, as these go with it."""
    words = [n_words(u) for u in lines]
    for n in range(1, length):
        for i in range(len(lines) - n + 1):
            part = words[i : i + n]
            if sum(part) >= min_words and (n == 1 or min(part) < min_words):
                yield i, n


def fingerprints(df: DataFrame, id_col: str, text_col: str, gram: int, window: int, min_words: int | None = None) -> DataFrame:
    """print (hash), doc_id, text_hash, and the digests of the runs of n lines that hold it: first (line of the first), runs."""
    length = gram + window - 1
    kind = pa.list_(pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(LINES)
        for b in batches:
            out = []
            for doc_id, text_hash, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                lines = [u for _, _, u in units(text.as_py(), pattern, 1, 0)]
                for at, n in short_runs(lines, length, min_words) if min_words else ():
                    one = [b"", *lines[at : at + n]]  # no line is empty, so no gram has this digest
                    out.append((_digest(one), doc_id, text_hash, at, n, [_wide(one)]))
                if len(lines) < length:
                    continue
                grams = [_digest(lines[i : i + gram]) for i in range(len(lines) - gram + 1)]
                runs = [_wide(lines[i : i + length]) for i in range(len(lines) - length + 1)]
                for at in winnow(grams, window):
                    first = max(0, at + gram - length)
                    out.append((grams[at], doc_id, text_hash, first, length, runs[first : at + 1]))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], kind)], ["print", "doc_id", "text_hash", "first", "n", "runs"])

    inner = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return inner.mapInArrow(run, "print long, doc_id long, text_hash long, first long, n long, runs array<binary>")


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, min_words: int | None = None) -> DataFrame:
    """A row for each text that loses lines: doc_id, text_hash and runs, sorted pairs (line, n) of the later runs: of
    `gram + window - 1` lines, or of fewer that hold `min_words` words (counted from 0 over lines that aren't blank)."""
    prints = materialize(fingerprints(df, id_col, text_col, gram, window, min_words), "prints")
    twice = materialize(prints.groupBy("print").count().where("count > 1").select("print"), "shared")
    places = prints.join(twice, "print", "left_semi").select("doc_id", "text_hash", "n", F.posexplode("runs").alias("k", "run"), "first")
    # several fingerprints of a text may hold a run; repeated rows count as one
    places = materialize(places.select("run", "doc_id", "text_hash", (F.col("first") + F.col("k")).alias("line"), F.col("n").alias("lines")).distinct(), "runs")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line", "text_hash")
    kept = materialize(places.groupBy("run").agg(F.count("*").alias("n"), F.min(rank).alias("kept")).where("n > 1"), "kept")
    later = places.join(kept, "run").where(rank > F.col("kept"))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("line", "lines"))).alias("runs"))


def removed_lines(text: str | None, runs: list) -> list[tuple[int, int, int, int]]:
    """(line, lines, start, stop) of the maximal runs that go; start and stop in characters, line ends excluded."""
    found, out = [(a, b) for a, b, _ in units(text, re.compile(LINES), 1, 0)], []
    for line, n in runs:
        if out and line <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], line + n - out[-1][0]))
        else:
            out.append((line, n))
    return [(line, n, found[line][0], found[line + n - 1][1]) for line, n in out]


def without(text: str, spans: list[tuple[int, int, int, int]]) -> str:
    """`text` without the runs and the line end after each."""
    out, at = [], 0
    for _, _, start, stop in spans:
        out.append(text[at:start])
        at = stop + 1 if text[stop : stop + 1] == "\n" else stop
    return "".join([*out, text[at:]])


def _with_runs(df: DataFrame, id_col: str, text_col: str, gram: int, window: int, min_words: int | None) -> DataFrame:
    """`df` with a last column `RUNS`, null for texts that lose nothing."""
    found = repeated_runs(df, id_col, text_col, gram, window, min_words).select(F.struct("doc_id", "text_hash").alias("at"), "runs")
    # as one column, so that the table's names can't clash
    whole = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash")).alias("key"))
    on = F.col("key.doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("key.text_hash") == F.col("at.text_hash"))
    joined = whole.join(found, on, "left")
    return joined.select("row.*", F.col("runs").alias(RUNS))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, min_words: int | None = None) -> DataFrame:
    """`df` with the later repeated runs of lines cut out of its texts; other columns stay.

    A run has `gram + window - 1` lines or more, or `min_words` words where that is given. Null and empty texts and texts
    without a run are left alone; whole texts are read, however long; a null id ranks last; repeated rows (equal id and
    text) count as one and lose the same lines; other columns may have any names; an empty table gives no rows.
    """

    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = b.column(b.num_columns - 1)
            text = pa.array([t.as_py() if not f.is_valid else without(t.as_py(), removed_lines(t.as_py(), [(r["line"], r["lines"]) for r in f.as_py()])) for t, f in zip(b.column(at), hit)], b.schema.field(at).type)
            cols = b.columns[:-1]
            cols[at] = text
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(list(b.schema)[:-1]))

    # plain names meanwhile, as names with dots can't be passed
    plain = _with_runs(df, id_col, text_col, gram, window, min_words).toDF(*[f"c{i}" for i in range(len(df.columns) + 1)])
    return plain.mapInArrow(run, StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)])).toDF(*df.columns)


def removed_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, min_words: int | None = None) -> DataFrame:
    """A row for each maximal run of lines that `dedup_lines` removes: doc_id, line, lines, start, stop."""
    names = ["doc_id", "line", "lines", "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, *r) for d, t, f in zip(*(c.to_pylist() for c in b.columns)) for r in removed_lines(t, [(x["line"], x["lines"]) for x in f])]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    hit = _with_runs(df.select(id_col, text_col), id_col, text_col, gram, window, min_words).where(F.col(f"`{RUNS}`").isNotNull())
    return hit.select(F.col(id_col).cast("long").alias("doc_id"), text_col, f"`{RUNS}`").mapInArrow(run, ", ".join(f"{n} long" for n in names))
