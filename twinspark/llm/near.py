"""Near duplicates by the exact similarity of their sets of shingles: no pair at the bar is left out.

Two sets whose common part is `bar` of all of theirs have that share of each in common. With the shingles of every set in
one order, the two then share one of the first n - ceil(bar n) + 1 of their n (prefix filtering), so a set is filed under
those alone. Any order is right; the one taken puts shingles that many texts of a sample have last, so buckets are small.

A bucket of up to `SMALL` sets proposes its pairs. A larger one proposes those with two of its members, then, as long as it holds
sets of several components, those with its best linked one, and at last all pairs that aren't connected: copies are not
expanded into pairs, and what is never met is connected already.

Sets aren't written whole. Of each there is its prefix and a string of parities, a bit for every residue of the hashes: two sets
differ in at least as many shingles as their parities do in bits, which rules out what is not similar. The shingles of the few
sets left are taken from their texts once more, and of those a pair's similarity is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.common import sifted
from twinspark.llm.simhash import SEED, shingle_hashes
from twinspark.operators.grouping import connected
from twinspark.sources.written import materialize

#: Sampled texts that frequent shingles are looked for in, texts that make one frequent, and most of these: they go to every
#: task. They decide an order, not a result.
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 4, 50_000
#: Sets of a bucket that all meet at once, and rows of a bucket that a task holds.
SMALL, HELD = 64, 200_000
#: Rounds in which large buckets meet one member more, and pairs left that end them early.
HUB_ROUNDS, FEW = 4, 2_000_000


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield b.slice(at, 256)


def _lists(found: list[np.ndarray], values: pa.DataType) -> pa.ListArray:
    ends = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), values))


def shingles(df: DataFrame, shingle: int) -> DataFrame:
    """g and s (the sorted hashes of its shingles) of each row of `df` (g, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            found = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(found, pa.int64())], ["g", "s"])

    return df.select("g", "text").mapInArrow(run, "g long, s array<long>")


def parities(s: np.ndarray) -> bytes:
    """For each residue of the hashes by a power of two, two to four times as many as there are, whether an odd number has it."""
    n = max(64, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s.view(np.uint64) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Shingles that are in one of two sets alone, at least: the bits in which their parities differ, the longer folded."""
    n = min(len(x), len(y))
    a, b = (np.bitwise_xor.reduce(np.frombuffer(p, np.uint8).reshape(-1, n), axis=0) for p in (x, y))
    return int(np.bitwise_count(a ^ b).sum())


def shingle_sets(df: DataFrame, id_col: str, text_col: str, shingle: int, bar: float, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, g (a hash of the set of shingles, which stands for it), n (its size), bits (its parities), prefix (what it is filed under), and
    columns `keep` of each row."""
    inner = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    kept = inner.schema.fields[2:]
    frequent = df.sparkSession.sparkContext.broadcast(_frequent(inner, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            found = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in part.column(1)]
            g = np.array([xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in found], np.uint64).view(np.int64)
            sets = [f.view(np.int64) for f in found]
            key, own = prefixes(sets, bar, frequent.value)
            prefix = _lists(np.split(key, np.searchsorted(own, np.arange(1, len(sets)))), pa.int64())
            cols = [part.column(0), pa.array(g), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(parities, sets), pa.binary()), prefix]
            yield pa.RecordBatch.from_arrays([*cols, *part.columns[2:]], ["doc_id", "g", "n", "bits", "prefix", *[f.name for f in kept]])

    ddl = ["doc_id long", "g long", "n long", "bits binary", "prefix array<long>", *[f"{f.name} {f.dataType.simpleString()}" for f in kept]]
    return inner.mapInArrow(run, ", ".join(ddl))


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a bounded sample, sorted, and how many sampled texts have each."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    drawn = docs.select(F.xxhash64("text").alias("g"), "text").where(F.pmod(F.col("g"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["g"])
    counts = shingles(drawn, shingle).select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).toPandas().sort_values("s")
    return rows.s.to_numpy(np.int64), rows.n.to_numpy(np.int64)


def prefixes(sets: list[np.ndarray], bar: float, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sets are filed under, and the number of the set that each is of."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    weight = np.zeros(len(flat), np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], flat), len(frequent[0]) - 1)
        weight = np.where(frequent[0][at] == flat, frequent[1][at], 0)
    order = np.lexsort((flat, weight, own))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    first = place < (size - np.ceil(bar * size - 1e-9).astype(np.int64) + 1)[own]
    return flat[order][first], own[first]


def _near_in_size(a: np.ndarray, b: np.ndarray, bar: float) -> np.ndarray:
    """A set of less than `bar` of another's size can't be as similar as that."""
    return np.minimum(a, b) >= bar * np.maximum(a, b) - 1e-9


def _proposed(sets: DataFrame, bar: float) -> DataFrame:
    """pair (a, b) of sets that may be similar; and where it is not a pair, the bucket (a) and member (b) of a large bucket. n: the member's size."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, star = np.zeros((0, 3), np.int64), None  # star: two members of the bucket that has been cut

        def pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            near = (x[:, 1] != y[:, 1]) & _near_in_size(x[:, 2], y[:, 2], bar)
            return np.stack([np.minimum(x[near, 1], y[near, 1]), np.maximum(x[near, 1], y[near, 1])], axis=1)

        def told(found: list[np.ndarray], large: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            both = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
            rows = np.concatenate([np.zeros((0, 3), np.int64), *large])
            for is_pair, a, b, n in ((True, both[:, 0], both[:, 1], np.zeros(len(both), np.int64)), (False, *rows.T)):
                for at in range(0, len(a), 50_000):
                    cut = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[cut]), is_pair)), *map(pa.array, (a[cut], b[cut], n[cut]))], ["pair", "a", "b", "n"])

        def solve(rows: np.ndarray, whole: bool = True) -> Iterator[pa.RecordBatch]:
            nonlocal star
            if not len(rows):
                return
            found, large = [], []
            if star is not None and star[0, 0] == rows[0, 0]:  # the rest of a bucket
                until = np.searchsorted(rows[:, 0], rows[0, 0], "right")
                part, rows = rows[:until], rows[until:]
                found += [pairs(np.repeat(h[None], len(part), axis=0), part) for h in star]
                large.append(part)
            edge = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else np.zeros(0, np.int64)
            size = np.diff(np.append(edge, len(rows)))
            two = edge[size == 2]
            found.append(pairs(rows[two], rows[two + 1]))
            for s, n in zip(edge[size > 2].tolist(), size[size > 2].tolist()):
                part = rows[s : s + n]
                if n <= SMALL and whole:
                    i, j = np.triu_indices(n, 1)
                    found.append(pairs(part[i], part[j]))
                else:
                    found += [pairs(np.repeat(h[None], n, axis=0), part) for h in part[:2]]
                    large.append(part)
                    star = part[:2]
            yield from told(found, large)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]  # copies of a text
            cut = np.searchsorted(rows[:, 0], rows[-1, 0])
            yield from solve(rows[:cut])
            held = rows[cut:]
            if len(held) > HELD:
                yield from solve(held, False)
                held = held[:0]
        yield from solve(held)

    keyed = sets.select(F.explode("prefix").alias("key"), "g", "n")
    return keyed.repartition("key").sortWithinPartitions("key", "g").mapInArrow(meet, "pair boolean, a long, b long, n long")


def _possible(pairs: DataFrame, sets: DataFrame, bar: float) -> DataFrame:
    """Those of pairs (a, b) that the parities of their sets don't rule out, once each."""
    own = sets.select("g", "n", "bits").dropDuplicates(["g"])
    x, y = (own.select(F.col("g").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            least = np.array([least_difference(p.as_py(), q.as_py()) for p, q in zip(batch.column(4), batch.column(5))], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(least <= (1 - bar) / (1 + bar) * n + 1e-6))

    both = pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return both.mapInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, bar: float) -> DataFrame:
    """Those of pairs (a, b) whose sets have a similarity of `bar` or more: their common shingles over all of theirs."""
    left = materialize(_possible(pairs, sets, bar), "possible")
    ends = left.select(F.explode(F.array("a", "b")).alias("g")).distinct()
    spots = sets.select("g", F.struct("file", "at").alias("spot")).join(ends, "g", "left_semi").groupBy("g").agg(F.min("spot").alias("spot"))
    spots = materialize(spots.select("g", "spot.file", "spot.at"), "spots")
    own = materialize(shingles(sifted(texts, spots, ["file", "at"]).where("sifted").join(spots, ["file", "at"]), shingle), "shingles")
    x, y = own.select(F.col("g").alias("a"), F.col("s").alias("x")), own.select(F.col("g").alias("b"), F.col("s").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return left.join(x, "a").join(y, "b").where(common >= bar * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def similar_components(sets: DataFrame, texts: DataFrame, shingle: int, bar: float) -> DataFrame:
    """node and root of every set that is linked: what pairs of a similarity of `bar` or more connect. Written `sets` (g, n, bits, prefix,
    file, at) are those of `texts` (file, at, text)."""
    found = materialize(_proposed(sets, bar), "proposed")
    pairs, members = found.where("pair").select("a", "b"), found.where("NOT pair").select(F.col("a").alias("key"), F.col("b").alias("g"), "n")
    good = materialize(_similar(pairs, sets, texts, shingle, bar), "similar")
    label = connected(good)
    if not members.take(1):
        return label
    for turn in range(HUB_ROUNDS + 1):
        # a bucket's members with their components; buckets of one component are done
        parted = members.join(label.withColumnRenamed("node", "g"), "g", "left").select("key", "g", "n", F.coalesce("root", "g").alias("own"))
        open_ = parted.groupBy("key").agg(F.min("own").alias("first"), F.max("own").alias("last")).where("first <> last").select("key")
        members = materialize(parted.join(open_, "key"), "members")
        sizes = members.groupBy("key", "own").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("same"))
        left = sizes.agg(F.sum((F.col("m") * F.col("m") - F.col("same")) / 2)).first()[0] or 0
        if not left:
            break
        last = left <= FEW or turn == HUB_ROUNDS
        other = members
        if not last:
            degree = good.select(F.explode(F.array("a", "b")).alias("g")).groupBy("g").agg(F.count("*").alias("links"))
            best = F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "g", "n", "own"))
            other = members.join(degree, "g", "left").groupBy("key").agg(best.alias("hub")).select("key", "hub.g", "hub.n", "hub.own")
        near = F.least("n", "m") >= bar * F.greatest("n", "m") - 1e-9
        met = members.join(other.select("key", F.col("g").alias("h"), F.col("n").alias("m"), F.col("own").alias("its")), "key").where((F.col("own") != F.col("its")) & near)
        new = _similar(met.select(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b")), sets, texts, shingle, bar)
        good = materialize(good.unionByName(new), "similar")
        label = connected(good)
        if last:
            break
        # the hub has met all that it isn't connected with
        members = members.join(other.select("key", "g"), ["key", "g"], "left_anti").drop("own")
    return label
