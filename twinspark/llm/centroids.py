"""Clustering around centroids in integers, with screening by block norms.

A vector is compressed to two numbers a segment of `SEGMENT` components: its sum and the norm of what the mean leaves. By
Cauchy-Schwarz the inner product of two vectors is at most that of their compressed forms, so that one small product of a
batch with all centroids gives a lower bound for each distance. A vector meets its centroids by rising bound, and only those
whose bound doesn't exceed the least distance so far get an exact integer distance.

Centroids are k rows and go to every task; a task gives the counts and sums of its clusters, at most k rows, which Spark adds
up. Whatever the table's size, the driver holds k centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.sources.written import materialize

SEGMENT = 4
#: Vectors whose bounds are worked out at once.
ROWS = 4096
#: Components beyond this (after scaling) could give distances beyond 64 bits.
LARGEST = 1 << 27


class Screen:
    """Centroids, numbered 0, 1, ..., with their compressed forms."""

    def __init__(self, centroids: np.ndarray):
        self.exact = centroids
        self.packed, self.squares = self.compressed(centroids)
        #: Pairs of a vector and a centroid, and those of them that got an exact distance.
        self.pairs = self.met = 0

    @staticmethod
    def compressed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector its segments' sums (over the root of the length) and the norms of the rest; its squared norm."""
        pad = -x.shape[1] % SEGMENT
        parts = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), (x.shape[1] + pad) // SEGMENT, SEGMENT).astype(float)
        squares, sums = (parts**2).sum(axis=2), parts.sum(axis=2) / np.sqrt(SEGMENT)
        return np.concatenate([sums, np.sqrt(np.maximum(squares - sums**2, 0))], axis=1), squares.sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid; of equally near ones the smallest number."""
        packed, squares = self.compressed(x)
        both = squares[:, None] + self.squares
        bound = both - 2 * (packed @ self.packed.T) - 1e-9 * (both + 1)  # the last for what floating point may lose
        order = np.argsort(bound, axis=1, kind="stable")
        best, found = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        for r in range(len(self.exact)):
            c = order[live, r]
            live, c = live[keep := bound[live, c] <= best[live]], c[keep]
            if not len(live):
                break
            d = ((x[live] - self.exact[c]) ** 2).sum(axis=1)
            self.met += len(live)
            better = (d < best[live]) | ((d == best[live]) & (c < found[live]))
            best[live[better]], found[live[better]] = d[better], c[better]
        self.pairs += len(x) * len(self.exact)
        return found, best


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """ids and components, `ROWS` vectors at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"a scaled component is beyond {LARGEST}: squared distances may not fit 64 bits")
            yield b.column(0), x


def integer_vectors(df: DataFrame, width: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, array<long>: floor(scale * component) of the vectors of `width` finite components; the others take no part."""
    vec = F.col(vector_col)
    ok = vec.isNotNull() & (F.size(vec) == width) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec, lambda x: F.floor(x.cast("double") * float(scale))).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of least sha256 of `seed:vec_id`, in that order; rows without id are never taken, ties go by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").orderBy(key, "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by floor(sum / count) of the vectors that are nearest to it; one without vectors stays."""
    k, width = centroids.shape
    spec = vectors.sparkSession.sparkContext.broadcast(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, sums, counts = Screen(spec.value), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, x in _batches(batches, width):
            found, _ = screen.nearest(x)
            order = np.argsort(found, kind="stable")
            own, first, n = np.unique(found[order], return_index=True, return_counts=True)
            sums[own] += np.add.reduceat(x[order], first, axis=0)
            counts[own] += n
        own = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * width, pa.int32()), pa.array(sums[own].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(counts[own]), lists], ["cluster", "n", "sums"])

    partial = vectors.mapInArrow(add, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    out = [list(map(int, c)) for c in centroids]
    for r in partial.groupBy("cluster", "at").agg(F.sum("part").alias("total"), F.sum("n").alias("n")).collect():  # k * width rows at most
        out[r["cluster"]][r["at"]] = r["total"] // r["n"]
    return np.array(out, np.int64)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of each vector."""
    width = centroids.shape[1]
    spec = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(spec.value)
        for ids, x in _batches(batches, width):
            found, d = screen.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(
    df: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """vec_id, cluster, distance (squared) of each kept vector after `rounds` rounds; cluster, centroid, cluster_inertia and
    inertia (distances summed over a cluster, and over all) of each centroid.

    Kept are vectors of exactly `width` components, none null or non-finite; each becomes floor(scale * x). Repeated rows
    count each; rows without id are clustered but never start a centroid; fewer kept vectors than k give as many
    centroids, none gives two empty tables. Equally near centroids: the smaller number. A cluster of most vectors is summed in
    every task like any other. A scaled component beyond 2^27 is an error. Other columns aren't read.
    """
    spark = df.sparkSession
    vectors = materialize(integer_vectors(df, width, scale, id_col, vector_col), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):  # without a centroid no vector has a cluster
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), spark.createDataFrame([], "cluster int, centroid array<long>, cluster_inertia long, inertia long")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = materialize(assigned(vectors, centroids), "assigned")
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    rows = [(i, list(map(int, c)), sums.get(i, 0), sum(sums.values())) for i, c in enumerate(centroids)]
    return found, spark.createDataFrame(rows, "cluster int, centroid array<long>, cluster_inertia long, inertia long")

