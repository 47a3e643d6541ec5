"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere go.

Every start of a string of `length` bytes has a key, the least hash of the grams in the string, so equal strings have
equal keys; starts of a text that stand together and share a key are a run (its bytes reach `length` - 1 further). Runs
are what the operator moves:

1. Keys, digests and places of all runs are written (no text). Runs whose digest occurs twice repeat as a whole.
2. Of keys with runs that differ (or a run that may hold a string twice), one run of each digest is fetched with its
   bytes; suffixes of these runs alone can still be equal. They are dealt out by key into blocks of bounded size, and each
   block's suffixes are sorted by external induced sorting (`induced`: queues on disk carry suffixes and their common
   prefixes, names are sorted by recursion); neighbours in that order whose common prefix reaches `length` repeat.
3. A key whose runs outgrow a block (a line that very many texts share) isn't gathered in one task: its starts meet by
   digest of their whole string, in an aggregate.
4. What repeats is told once for each run: a run that occurs twice goes as a whole at each of its places, and only of a
   run that occurs once are there spans of starts. So a place meets a few rows. Each text's bytes are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspark.sources.written import materialize
from twinspark.llm.induced import repeated

LENGTH = 400
GRAM = 128
#: Bytes of runs sorted at once, and of a key beyond which its starts are dealt out by digest.
BLOCK_BYTES = 2 << 20
KEY_BYTES = 1 << 20

_MUL = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each `gram` bytes (a power of two) of b."""
    h, n, power = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1, _MUL
    while n < gram:
        h = h[:-n] * np.uint64(power) + h[n:]
        power = power * power & _MASK
        n *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def least_of_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if width > have else h


def runs(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, n, own) of the runs of starts whose strings share the least gram.

    own: the gram is there twice, as it is in a run that holds some string twice.
    """
    if len(b) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    h, width = gram_hashes(b, gram), length - gram + 1
    least = least_of_windows(h, width)
    edge = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    key, n = least[edge], np.diff(np.append(edge, len(least)))
    own = [np.count_nonzero(h[a : a + m + width - 1] == k) > 1 for a, m, k in zip(edge.tolist(), n.tolist(), key)]
    return key, edge, n, np.array(own)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _digest(b: bytes) -> int:
    return int.from_bytes(blake2b(b, digest_size=8).digest(), "little", signed=True)


def _places(df: DataFrame, length: int, gram: int) -> DataFrame:
    """key, digest, doc_id, text_hash, start, n and own (0 or 1) of every run."""
    names = ["key", "digest", "doc_id", "text_hash", "start", "n", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = _bytes(text.as_py())
                key, start, n, own = runs(np.frombuffer(raw, np.uint8), length, gram)
                cols[0] += key.view(np.int64).tolist()
                cols[1] += [_digest(raw[a : a + m + length - 1]) for a, m in zip(start.tolist(), n.tolist())]
                cols[2] += [doc_id] * len(key)
                cols[3] += [text_hash] * len(key)
                cols[4] += start.tolist()
                cols[5] += n.tolist()
                cols[6] += own.astype(int).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return df.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _fetched(df: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """key, digest, n, once (it has one place), large and bytes of each of `wanted`."""
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("once", pa.bool_()), ("large", pa.bool_()), ("bytes", pa.binary())])
    by_text = wanted.groupBy(F.col("at.doc_id").alias("__id"), F.col("at.text_hash").alias("__hash")).agg(F.collect_list(F.struct("key", "digest", "n", "once", "large", F.col("at.start").alias("start"))).alias("runs"))
    joined = df.join(by_text, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(0), batch.column(1)):
                raw = _bytes(text.as_py())
                out += [(r["key"], r["digest"], r["n"], r["once"], r["large"], raw[r["start"] : r["start"] + r["n"] + length - 1]) for r in found.as_py()]
                if len(out) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # of repeated rows each fetches the same runs; the sorting keeps one
    return joined.mapInArrow(run, "key long, digest long, n long, once boolean, large boolean, bytes binary")


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (start, stop) of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def sorted_block(block: list[tuple], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(key, digest, from, to): the starts of each run (key, digest, n, once, bytes) whose string occurs twice in the block.

    Runs that occur more than once take part but aren't told: all their starts repeat.
    """
    seen, unique = set(), []
    for r in block:
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            unique.append(r)
    t = np.frombuffer(b"".join(r[4] for r in unique), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(r[4]) for r in unique])])
    valid = np.zeros(len(t), bool)
    for r, at in zip(unique, begin.tolist()):
        valid[at : at + r[2]] = True
    hit = repeated(t, valid, length)
    for r, at in zip(unique, begin.tolist()):
        for a, b in _spans(hit[at : at + r[2]]) if r[3] else ():
            yield r[0], r[1], a, b


def _by_suffix(fetched: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """key, digest, from, to by sorting blocks of whole keys."""
    names = ["key", "digest", "from", "to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0

        def solve() -> pa.RecordBatch:
            cols = list(zip(*sorted_block(block, length))) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= block_bytes and r[0] != block[-1][0]:
                    yield solve()
                    block, size = [], 0
                block.append(r)
                size += len(r[4])
        if block:
            yield solve()

    rows = fetched.select("key", "digest", "n", "once", "bytes").repartition("key").sortWithinPartitions("key", "digest")
    return rows.mapInArrow(run, ", ".join(f"`{n}` long" for n in names))


def _by_digest(fetched: DataFrame, length: int) -> DataFrame:
    """The same for keys with too many runs for a block, by a digest of each start's string."""
    names = ["key", "digest", "once", "at", "d0", "d1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, digest, n, once, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                two = np.frombuffer(b"".join(blake2b(raw[i : i + length], digest_size=16).digest() for i in range(n)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, digest)), pa.array(np.full(n, once)), pa.array(np.arange(n)), pa.array(two[:, 0]), pa.array(two[:, 1])], names)

    one = fetched.select("key", "digest", "n", "once", "bytes").mapInArrow(run, "key long, digest long, once boolean, at long, d0 long, d1 long").distinct()
    one = materialize(one, "strings")
    twice = materialize(one.groupBy("d0", "d1").count().where("count > 1").select("d0", "d1"), "twice")
    hit = one.where("once").join(twice, ["d0", "d1"], "left_semi")
    # starts that stand together are one span; a run has as many starts as it has bytes, at most
    island = F.col("at") - F.row_number().over(Window.partitionBy("key", "digest").orderBy("at"))
    spans = hit.withColumn("island", island).groupBy("key", "digest", "island").agg(F.min("at").alias("from"), (F.max("at") + 1).alias("to"))
    return spans.drop("island")


def suffix_dedup(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key_bytes: int = KEY_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte offsets start, stop, flat) of each row.

    Null and empty texts have no bytes; whole texts are read, however long; texts of fewer than `length` bytes keep all; repeated rows are each other's
    repetition, whatever their ids, null ids included; other columns aren't read; an
    empty table gives no rows. `length` is `gram` or more.
    """
    if length < gram or gram & (gram - 1):
        raise ValueError("gram must be a power of two, and length no less")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    places = materialize(_places(docs.select("doc_id", "text_hash", "text"), length, gram), "places")
    kinds = materialize(places.groupBy("key", "digest").agg(F.count("*").alias("places"), F.first("n").alias("n"), F.max("own").alias("own"), F.min(F.struct("doc_id", "text_hash", "start")).alias("at")), "kinds")
    shared = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max("own").alias("own"), F.sum(F.col("n") + length - 1).alias("bytes")).where("kinds > 1 or own = 1")
    shared = materialize(shared.select("key", (F.col("bytes") > key_bytes).alias("large")), "shared")
    fetched = materialize(_fetched(docs, kinds.withColumn("once", F.col("places") == 1).drop("own").join(shared, "key"), length), "fetched")
    found = _by_suffix(fetched.where("not large"), length, block_bytes)
    if not shared.where("large").isEmpty():
        found = found.unionByName(_by_digest(fetched.where("large"), length))
    whole = kinds.where("places > 1").select("key", "digest", F.lit(0).cast("long").alias("from"), F.col("n").alias("to"))
    found = materialize(whole.unionByName(found), "found")
    hits = places.join(found, ["key", "digest"]).select("doc_id", "text_hash", F.struct((F.col("start") + F.col("from")).alias("a"), (F.col("start") + F.col("to") + length - 1).alias("b")).alias("span"))
    spans = hits.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_set("span")).alias("found"))
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left").select("doc_id", "text", "found")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, sha, flat = [], [], [], [], []
            for text, got in zip(batch.column(1), batch.column(2)):
                raw, merged = _bytes(text.as_py()), []
                for s in got.as_py() or ():
                    if merged and s["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["b"])
                    else:
                        merged.append([s["a"], s["b"]])
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                n_bytes.append(len(raw))
                n_removed.append(sum(b - a for a, b in merged))
                n_spans.append(len(merged))
                sha.append(kept.hexdigest())
                flat.append([x for m in merged for x in m])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)], pa.array(sha, pa.string()), pa.array(flat, pa.list_(pa.int64()))], names)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>")
