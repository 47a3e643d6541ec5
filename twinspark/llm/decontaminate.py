"""Benchmark decontamination by a distributed positional inverted index.

`index` stores the postings of all documents: a row holds a block of documents of one task with its terms and, term by
term, the positions of their tokens. It is a written table, made once and searched by any number of benchmarks. A test phrase
starts from the postings of its rarest term in a block, shifted to where the phrase would begin, and is intersected
with the shifted postings of its other terms, rarest first; what remains in one document are exact matches. All phrases take
these steps together, `CANDIDATES` places at a time. A proximity match has all terms of a phrase, in any order, in a span
of the phrase's length plus `slop` words.

The benchmark is a broadcast table of at most `BLOCK_WORDS` words; a larger one is cut into blocks of that size, each
of which searches the index in turn and writes what it finds, so it needs no bound.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.common import placed
from twinspark.sources.written import materialize

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Tokens of a block of documents in the index; a longer document is a block of its own.
INDEX_TOKENS = 1_000_000
#: Blocks in a file of the index, about 5 MB each.
FILE_BLOCKS = 4
#: Places compared at once in a search.
CANDIDATES = 1_000_000

_KEEP = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of `text` with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Phrases:
    """The distinct windows of a block of items as rows of term numbers (-1 after the end of a short one)."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item_id)
        self.items = [sorted(x) for x in found.values()]
        self.length = np.array([len(w) for w in found], dtype=np.int64)
        self.rows = np.full((len(found), window), -1, dtype=np.int64)
        for i, w in enumerate(found):
            self.rows[i, : len(w)] = w


class Block:
    """The postings that a block of the index has for the terms of phrases; positions run through its documents."""

    def __init__(self, row: dict[str, pa.Scalar], terms: pa.Array):
        positions = np.frombuffer(row["positions"].as_buffer(), np.int32)
        bounds = row["starts"].values.to_numpy()
        own = pc.index_in(terms, value_set=row["terms"].values).fill_null(-1).to_numpy(zero_copy_only=False)
        self.counts = np.where(own >= 0, bounds[own + 1] - bounds[own], 0)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        kind = np.repeat(np.arange(len(own)), self.counts)
        self.positions = positions[bounds[own][kind] + np.arange(len(kind)) - self.starts[kind]].astype(np.int64)
        self.keys = kind << 32 | self.positions  # ascending
        self.ends = row["ends"].values.to_numpy()

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.starts[term] : self.starts[term + 1]]

    def doc(self, at: np.ndarray) -> np.ndarray:
        """The documents that hold these positions."""
        return np.searchsorted(self.ends, at, side="right")

    def exact(self, p: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which phrases begin where, in parts."""
        some = self.present(p.rows)
        counts = np.where(p.rows[some] >= 0, self.counts[p.rows[some]], 1 << 40)
        order, rarest = np.argsort(counts, axis=1, kind="stable"), counts.min(axis=1, initial=1 << 40)
        parts = np.cumsum(rarest) // CANDIDATES
        for part in np.unique(parts):
            these = np.flatnonzero(parts == part)
            i = np.repeat(these, rarest[these])
            term = p.rows[some[i], order[i, 0]]
            begin = self.positions[self.starts[term] + np.arange(len(i)) - np.searchsorted(i, i)] - order[i, 0]
            i, begin = i[begin >= 0], begin[begin >= 0]
            for step in range(1, p.rows.shape[1]):
                at = order[i, step]
                term = p.rows[some[i], at]
                want = term << 32 | begin + at
                found = self.keys[np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)] == want
                stay = found | (term < 0)  # a short phrase has no more terms
                i, begin = i[stay], begin[stay]
            which = some[i]
            inside = begin + p.length[which] <= self.ends[np.minimum(self.doc(begin), len(self.ends) - 1)]
            yield which[inside], begin[inside]

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """First positions of spans of `len(terms) + slop` words that hold every term as often as the phrase does."""
        width, kinds, need = len(terms) + slop, *np.unique(terms, return_counts=True)
        order = np.argsort(self.counts[kinds], kind="stable")
        rare = self.postings(kinds[order[0]])
        starts = np.sort(np.concatenate([self.postings(k) for k in kinds]))  # a span begins with one of the terms
        starts = starts[np.searchsorted(rare, starts + width) > np.searchsorted(rare, starts)]
        for o in order:
            if not len(starts):
                break
            other, until = self.postings(kinds[o]), np.minimum(starts + width, self.ends[self.doc(starts)])
            starts = starts[np.searchsorted(other, until) - np.searchsorted(other, starts) >= need[o]]
        return starts

    def present(self, rows: np.ndarray) -> np.ndarray:
        """Which phrases have all their terms here."""
        counts = np.append(self.counts, 1)  # for -1
        return np.flatnonzero(counts[rows].min(axis=1) > 0) if len(rows) else np.zeros(0, dtype=np.int64)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks; the driver holds one at a time."""
    block, n = [], 0
    for item_id, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(id_col).isNotNull()).toLocalIterator():
        more = len(words(text))
        if block and n + more > block_words:
            yield block
            block, n = [], 0
        if more:
            block.append((item_id, text))
            n += more
    yield block


def index(df: DataFrame, key: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The positional index of `df` as a written table, a row a block of documents.

    block, docs (key as string, n_words and columns `keep` as keep_0, ... of each), ends (of documents, in tokens), terms,
    starts (of the postings of each term, and their end), positions (32-bit, by term, ascending). Null or empty texts are
    documents without words; repeated rows are documents each; an empty table has no blocks. A file has `FILE_BLOCKS` blocks at most,
    so that what a task holds doesn't grow with its share of the documents.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    kept = "".join(f", keep_{i}: {df.select(c).schema[0].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                number: defaultdict[bytes, int] = defaultdict(count().__next__)
                parts, ends, total, first = [], [], 0, at
                while at < batch.num_rows and total + len(ends) < INDEX_TOKENS:
                    doc = words(batch.column(1)[at].as_py())
                    parts.append(np.fromiter(map(number.__getitem__, doc), np.int64, len(doc)))
                    total += len(doc)
                    ends.append(total)
                    at += 1
                tokens = np.concatenate(parts)
                positions = (np.sort(tokens << 32 | np.arange(total)) & 0xFFFFFFFF).astype(np.int32)
                starts = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=len(number)))])
                part = batch.slice(first, at - first)
                docs = pa.StructArray.from_arrays([part.column(0), pa.array(np.diff(ends, prepend=0)), *part.columns[2:]], ["key", "n_words", *part.schema.names[2:]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(blocks)]), pa.ListArray.from_arrays(pa.array([0, at - first], pa.int32()), docs), pa.array([ends], pa.list_(pa.int64())), pa.array([list(number)], pa.list_(pa.binary())), pa.array([starts], pa.list_(pa.int64())), pa.array([positions.tobytes()], pa.binary())],
                    ["block", "docs", "ends", "terms", "starts", "positions"],
                )

    made = rows.mapInArrow(run, f"block long, docs array<struct<key: string, n_words: bigint{kept}>>, ends array<bigint>, terms array<binary>, starts array<bigint>, positions binary")
    return materialize(made, "postings", FILE_BLOCKS)


def _search(stored: DataFrame, phrases: Phrases, slop: int | None) -> DataFrame:
    """block, doc (its place in the block), hits (pairs start, end of words), near and items of documents with any."""
    spec = stored.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = spec.value
        terms = pa.array(list(p.terms), pa.binary())
        for batch in batches:
            for r in range(batch.num_rows if len(p.rows) else 0):
                block = Block({c: batch.column(c)[r] for c in ("ends", "terms", "starts", "positions")}, terms)
                yield found(block, p, batch.column("block")[r].as_py())

    def found(block: Block, p: Phrases, number: int) -> pa.RecordBatch:
        first = np.concatenate([[0], block.ends[:-1]])
        hits, near, items = defaultdict(list), defaultdict(list), defaultdict(set)
        for which, begin in block.exact(p):
            doc = block.doc(begin)
            for i, d, s in zip(which.tolist(), doc.tolist(), (begin - first[doc]).tolist()):
                hits[d] += [s, s + int(p.length[i])]
                items[d].update(p.items[i])
        for i in block.present(p.rows) if slop is not None else ():
            begin = block.near(p.rows[i, : p.length[i]], slop)
            doc = block.doc(begin)
            for d, s in zip(doc.tolist(), (begin - first[doc]).tolist()):
                near[d].append(s)
        docs = sorted({*hits, *near})
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(docs), pa.int64()), pa.array(docs, pa.int32()), pa.array([hits[d] for d in docs], pa.list_(pa.int64())), pa.array([near[d] for d in docs], pa.list_(pa.int64())), pa.array([sorted(items[d]) for d in docs], pa.list_(pa.string()))],
            ["block", "doc", "hits", "near", "items"],
        )

    return stored.select("block", "ends", "terms", "starts", "positions").mapInArrow(run, "block long, doc int, hits array<bigint>, near array<bigint>, items array<string>")


def matches(df: DataFrame, benchmark: DataFrame, key: str, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of `df`: key (as string), n_words, hits, near, items, and columns `keep` as keep_0, ...

    `hits` has word positions (start, end), flat, of each exact match of a window of `window` consecutive item words (the
    whole item where it is shorter); `near`, given `slop`, the starts of proximity matches; `items` the sorted ids of items
    with exact matches. Null or empty texts have no words; items without id or words take no part; repeated item ids count
    once; repeated rows are each answered; an empty benchmark matches nothing; columns of other names don't clash.
    """
    stored = index(df, key, text_col, keep)
    found = [materialize(_search(stored, Phrases(b, window), slop), "matches") for b in _blocks(benchmark, item_id, item_text, block_words)]
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    of_doc = reduce(DataFrame.unionAll, found).groupBy("block", "doc").agg(flat("hits"), flat("near"), F.array_sort(F.array_distinct(flat("items"))).alias("items"))
    docs = stored.select("block", F.posexplode("docs").alias("doc", "row"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return docs.join(of_doc, ["block", "doc"], "left").select("row.key", "row.n_words", none("hits", "bigint"), none("near", "bigint"), none("items", "string"), *[f"row.keep_{i}" for i in range(len(keep))])


def merged(hits: list[int]) -> list[tuple[int, int]]:
    """Disjoint sorted spans of words."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(hits[::2], hits[1::2])):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The digest of `matches`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of hit words."""
    found = matches(df, benchmark, id_col, **options)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [merged(h) for h in b.column("hits").to_pylist()]
            n_hit = [sum(e - s for s, e in x) for x in spans]
            items = b.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array([[v for s in x for v in s] for x in spans], pa.list_(pa.int64()))],
                ["key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    out = found.select("key", "n_words", "hits", "items").mapInArrow(digest, "key string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<bigint>")
    return out.select(F.col("key").cast(df.schema[id_col].dataType).alias(id_col), *out.columns[1:])


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `df` without an exact match, as they are; a row goes by its place in the files, not by its id."""
    rows, names = placed(df), df.columns
    found = matches(rows, benchmark, f"c{names.index(id_col)}", f"c{names.index(text_col)}", keep=("file", "at"), **options).where(F.size("hits") > 0)
    gone = materialize(found.select(F.col("keep_0").alias("file"), F.col("keep_1").alias("at")), "gone")
    return rows.join(gone, ["file", "at"], "left_anti").drop("file", "at").toDF(*names)
