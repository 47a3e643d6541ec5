"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has words of 64 bits. Two words that differ in at most t bits are cut into t + 1 segments on a ring; by the
pigeonring principle some chain of consecutive segments keeps within its proportional budget at every length l,
floor(l t / (t + 1)) differences: none in its first segment, at most one in its first two. So every fingerprint is filed
under each start's first segments as they are and with set bits cleared, as many as the chain's budget allows; two that
keep the budgets meet in a bucket, where the full Hamming distance is checked. The more fingerprints there are, the
longer are the chains in the keys.

Fingerprints may be routed by words of another shingle (`Route`): an edit of one word changes five shingles of five words,
but two of two, so pairs at the bar differ in a tenth of the routing bits instead of a sixth, and segments are longer.

Only distinct fingerprints are filed. A bucket gives links that connect what it connects, not all its pairs, and tells a
link only if its key is the least that the two ends share: elsewhere the ends stand in one tree of that bucket as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.common import placed, sifted
from twinspark.operators.grouping import connected
from twinspark.sources.written import materialize

SEED = 42
#: Expected rows of a bucket from which keys take a third segment.
BUCKET = 2048
#: Rows of a bucket that are compared as one matrix; larger buckets are searched from link to link.
MATRIX = 1024


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Independent bits for further words of a fingerprint; word 0 is the hash itself."""
    if not word:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, repeats included; of all words where there are fewer; empty without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(found) <= shingle:
        h = np.array([digest(b" ".join(found), SEED)], dtype=np.uint64)
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate([[0], ends[:-shingle]]).tolist()
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(starts))
    return h


def fingerprint(text: str | None, shingle: int, n_words: int = 1) -> list[int]:
    """64-bit words (unsigned) of the fingerprint; 0 for texts without words."""
    h, out = shingle_hashes(text, shingle), []
    if not len(h):
        return [0] * n_words
    for w in range(n_words):
        bits, x = np.zeros(64, np.int64), _mixed(h, w)
        for at in range(0, len(x), 200):  # counts of so many bits fit into a byte
            part = np.unpackbits(x[at : at + 200].astype(">u8").view(np.uint8)).reshape(-1, 64)
            bits += part.sum(axis=0, dtype=np.uint8)
        out.append(int.from_bytes(np.packbits(2 * bits > len(x)).tobytes(), "big"))
    return out


class Route(NamedTuple):
    """Candidates differ in at most `max_bits` bits of one of `words` 64-bit words over shingles of `shingle` words."""

    shingle: int
    words: int
    max_bits: int


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int, n_words: int, route: Route | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, f0.. and for a route r0.. (64-bit words as long) of each row, and columns `keep` as keep_0, ..."""
    names = [f"f{w}" for w in range(n_words)] + [f"r{w}" for w in range(route.words if route else 0)]
    inner = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    kept = inner.schema.fields[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            got = [fingerprint(t, shingle, n_words) + (fingerprint(t, route.shingle, route.words) if route else []) for t in texts]
            words = np.array(got, dtype=np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(words[:, w]) for w in range(len(names))], *b.columns[2:]], ["doc_id", *names, *[f.name for f in kept]])

    ddl = ["doc_id long", *[f"{n} long" for n in names], *[f"{f.name} {f.dataType.simpleString()}" for f in kept]]
    return inner.mapInArrow(run, ", ".join(ddl))


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, length) of the max_bits + 1 segments of a 64-bit word."""
    m = max_bits + 1
    cut = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def chain_length(n: int, max_bits: int) -> int:
    """Segments in a bucket's key for n fingerprints: two, or as many more as keep the expected bucket within `BUCKET`."""
    m, rows = max_bits + 1, {0: 1.0}  # keys of a start by how many bits they have cleared
    for depth in range(m):
        half = 64 / m / 2  # set bits of a segment
        ways = [1.0]
        while len(ways) <= max_bits:
            ways.append(ways[-1] * max(0.0, half - len(ways) + 1) / len(ways))
        grown: dict[int, float] = {}
        for used, r in rows.items():
            for k in range((depth + 1) * max_bits // m - used + 1):
                grown[used + k] = grown.get(used + k, 0.0) + r * ways[k]
        rows = grown
        if depth >= 1 and n * sum(rows.values()) / 2 ** (64 * (depth + 1) / m) <= BUCKET:
            return depth + 1
    return m


def bucket_keys(f: np.ndarray, word: int, max_bits: int, chain: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the fingerprints' 64-bit word `word`, and the rows that they are of.

    Two words that differ by a chain's budgets share the key in which each has cleared the bits that the other lacks.
    """
    keys, rows = [], []
    parts = segments(max_bits)
    m = len(parts)
    for i in range(m):
        # keys so far, their rows, and how many bits they have cleared
        tag = _mixed(np.array([i], dtype=np.uint64), word + 1)
        found = [(np.zeros(len(f), np.uint64), np.arange(len(f)), 0)]
        for depth in range(min(chain, m)):
            shift, length = parts[(i + depth) % m]
            grown = []
            for key, r, used in found:
                seg = f[r] >> np.uint64(shift) & np.uint64((1 << length) - 1)
                key = key << np.uint64(length) if length < 64 else key
                for n in range((depth + 1) * max_bits // m - used + 1):
                    for bits in combinations(range(length), n):
                        mask = np.uint64(sum(1 << b for b in bits))
                        has = np.flatnonzero(seg & mask == mask) if n else slice(None)
                        grown.append((key[has] | seg[has] ^ mask, r[has], used + n))
            found = grown
        # starts that share a key by chance only share a bucket
        keys += [_mixed(k ^ tag, 1) for k, _, _ in found]
        rows += [r for _, r, _ in found]
    return np.concatenate(keys), np.concatenate(rows)


def close(x: np.ndarray, y: np.ndarray, max_bits: int, n_words: int, each: int) -> np.ndarray:
    """Whether x and y (words last: `n_words` to compare, then routing words, if any) differ in at most `max_bits` bits of
    the former and at most `each` of some routing word."""
    d = np.bitwise_count(x ^ y)
    ok = d[..., :n_words].sum(axis=-1, dtype=np.int16) <= max_bits
    return ok & (d[..., n_words:].min(axis=-1) <= each) if d.shape[-1] > n_words else ok


def links(f: np.ndarray, max_bits: int, n_words: int | None = None, each: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) that link, as many as connect all that links connect. f: distinct fingerprints, a column a word."""
    n, n_words = len(f), n_words or f.shape[1]
    if n <= MATRIX:
        near = np.concatenate([close(f[at : at + 128, None], f[None], max_bits, n_words, each) for at in range(0, n, 128)])
        i, j = np.nonzero(np.triu(near, 1))
        if len(i) <= 2 * n:
            return i, j
    left, a, b = np.arange(n), [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = close(f[left], f[x], max_bits, n_words, each)
            found = left[near]
            if len(found):
                a.append(np.full(len(found), x))
                b.append(found)
                stack += found.tolist()
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def told_here(f: np.ndarray, max_bits: int, chain: int, i: np.ndarray, j: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether `key` is the least key that rows i and j of `f` (routing words, a column each) share."""
    if not len(i):
        return np.zeros(0, bool)
    keys, rows = map(np.concatenate, zip(*(bucket_keys(np.ascontiguousarray(f[:, w]), w, max_bits, chain) for w in range(f.shape[1]))))
    kinds, rank = np.unique(keys, return_inverse=True)
    codes = np.unique(rows.astype(np.int64) * len(kinds) + rank)  # a row's keys, in order
    first = np.searchsorted(codes // len(kinds), np.arange(len(f) + 1))
    own, out = np.searchsorted(kinds, key), np.zeros(len(i), bool)
    for at in range(0, len(i), 20_000):
        a, b = i[at : at + 20_000], j[at : at + 20_000]
        n = first[a + 1] - first[a]
        pair = np.repeat(np.arange(len(a)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a], n)
        other = codes[place] % len(kinds)
        want = b[pair] * len(kinds) + other
        shared = codes[np.minimum(np.searchsorted(codes, want), len(codes) - 1)] == want
        least = np.full(len(a), len(kinds))
        np.minimum.at(least, pair[shared], other[shared])
        out[at : at + 20_000] = least == own[at : at + 20_000]
    return out


def _edges(nodes: DataFrame, names: list[str], routed: list[str], max_bits: int, each: int, chain: int | None = None) -> DataFrame:
    """Links between distinct fingerprints, as (a, b) of their numbers `nid`: at most `max_bits` bits apart over `names`,
    and at most `each` in some word of `routed`."""
    chain = chain or chain_length(nodes.count(), each)
    only = [c for c in names if c not in routed]
    cols = ["key", "nid", *routed, *only]
    n_routed, check = len(routed), [2 + (routed + only).index(c) for c in names + [c for c in routed if c not in names]]
    ddl = ", ".join(f"{c} long" for c in cols)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in range(n_routed):
                f = b.column(1 + w).to_numpy(zero_copy_only=False).view(np.uint64)
                keys, rows = bucket_keys(f, w, each, chain)
                for at in range(0, len(keys), 50_000):
                    r = pa.array(rows[at : at + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000].view(np.int64)), *[c.take(r) for c in b.columns]], cols)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(block: np.ndarray) -> pa.RecordBatch:
            """block: whole buckets, a row (key, nid, routing words, other words) each."""
            edge = np.flatnonzero(np.concatenate([[True], block[1:, 0] != block[:-1, 0]]))
            size = np.diff(np.append(edge, len(block)))
            words = block[:, check].view(np.uint64)
            two = edge[size == 2]  # most shared buckets
            near = two[close(words[two], words[two + 1], max_bits, len(names), each)]
            a, b = [near], [near + 1]
            for s, n in zip(edge[size > 2].tolist(), size[size > 2].tolist()):
                i, j = links(words[s : s + n], max_bits, len(names), each)
                a.append(s + i)
                b.append(s + j)
            a, b = np.concatenate(a), np.concatenate(b)
            ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            i, j, route = at[: len(a)], at[len(a) :], block[ends][:, 2 : 2 + n_routed].view(np.uint64)
            told = told_here(route, each, chain, i, j, block[a, 0].view(np.uint64))
            a, b = a[told], b[told]
            x, y = block[a, 1], block[b, 1]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)  # a key may hold a row twice
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if held and held[-1][-1, 0] == rows[-1, 0]:  # one bucket so far
                held.append(rows)
                if held[0][0, 0] == rows[-1, 0]:
                    continue
            elif held:
                held.append(rows)
            else:
                held = [rows]
            block = np.concatenate(held)
            cut = np.searchsorted(block[:, 0], block[-1, 0])
            held = [block[cut:]]
            if cut:
                yield solve(block[:cut])
        if held:
            yield solve(np.concatenate(held))

    keyed = nodes.select("nid", *routed, *only).mapInArrow(file, ddl)
    return keyed.repartition("key").sortWithinPartitions("key", "nid").mapInArrow(meet, "a long, b long")


#: Pairs at the bar differ in 5 bits of a word of this route on average (8 or less in 9 of 10 words) where words are
#: edited here and there, and in 9 or 10 where a piece is replaced: one word of three is then near enough in 9 of 10 pairs.
ROUTE = Route(shingle=2, words=3, max_bits=9)


def near_duplicates(df: DataFrame, shingle: int = 5, max_bits: int = 48, n_words: int = 4, id_col: str = "doc_id", text_col: str = "text", route: Route | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, f0.., component (its number) and component_id, the least id that links reach, for every row, and columns
    `keep` as keep_0, ...

    Two rows link if their fingerprints differ in at most `max_bits` bits and their routing words keep `route`; without a
    route the fingerprint's own words route, each with its share of the bits, which loses no link. The defaults stand for
    a similarity of 0.8 or more of sets of five-word shingles, at which 39 of 256 bits differ on average (30 at 0.87).

    Null and empty texts share the fingerprint zero; whole texts are read, however long; rows that share an id are rows of
    their own; a component whose ids are all null has a null id; other columns may have any names; an empty table gives no rows.
    """
    names = [f"f{w}" for w in range(n_words)]
    routed = [f"r{w}" for w in range(route.words)] if route else names
    every = names + [c for c in routed if c not in names]
    docs = materialize(fingerprints(df, id_col, text_col, shingle, n_words, route, keep), "fingerprints")
    # the number is steady once the table is written
    nodes = materialize(docs.groupBy(*every).agg(F.min("doc_id").alias("least")).withColumn("nid", F.monotonically_increasing_id()), "nodes")
    edges = _edges(nodes, names, routed, max_bits, route.max_bits if route else max_bits // n_words)
    found = materialize(connected(edges), "components")
    roots = nodes.join(found, nodes.nid == found.node).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = found.join(roots, "root").select(F.col("node").alias("nid"), "root", "component_id")
    placed = nodes.join(linked, "nid", "left").select(*every, F.coalesce("root", "nid").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    # written, so that a fingerprint of very many documents is a skewed join of two exchanges, which Spark splits
    return docs.join(materialize(placed, "placed"), every).select("doc_id", *names, "component", "component_id", *[f"keep_{i}" for i in range(len(keep))])


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bar: float = 0.8) -> DataFrame:
    """`df` with one row of each component of near duplicates: the least id, of rows that share it any one.

    Texts link if the exact similarity of their sets of shingles is `bar` or more, and every such pair counts (`near`), as do
    texts without words among each other. A row is removed as a row, not by its id: by its place in the files that `df` is
    read from (a table that isn't read from files is written first). Rows without id stay.
    """
    from twinspark.llm import near

    names, rows = df.columns, placed(df)
    texts = rows.select("file", "at", F.col(f"c{names.index(text_col)}").alias("text"))
    sets = materialize(near.shingle_sets(rows, f"c{names.index(id_col)}", f"c{names.index(text_col)}", shingle, bar, ("file", "at")), "sets")
    label = materialize(near.similar_components(sets, texts, shingle, bar), "components")
    own = sets.where("doc_id is not null").select("g", F.struct("doc_id", "file", "at").alias("place"))
    least = own.groupBy("g").agg(F.min("place").alias("least")).join(label.withColumnRenamed("node", "g"), "g", "left").select("g", F.coalesce("root", "g").alias("component"), "least")
    least = materialize(least, "least")
    kept = least.join(least.groupBy("component").agg(F.min("least").alias("kept")), "component").select("g", "kept")
    # written, so that a text of very many copies is a skewed join of two exchanges, which Spark splits
    gone = own.join(materialize(kept, "kept"), "g").where("place <> kept").select("place.file", "place.at")
    gone = materialize(gone, "gone")
    all_ = sifted(rows, gone, ["file", "at"])
    # only rows that may go are moved
    kept = all_.where("NOT sifted").unionByName(all_.where("sifted").join(gone, ["file", "at"], "left_anti"))
    return kept.drop("file", "at", "sifted").toDF(*names)
