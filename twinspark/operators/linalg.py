"""Matrix fits and losses. Sums of products are gathered by partition; only d x d matrices reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def mean_vector(df: DataFrame, v: str = "v") -> DataFrame:
    """dim and mean."""
    return df.select(F.posexplode(v).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))


def scatter(df: DataFrame, v: str = "v") -> DataFrame:
    """i, j, s: the sum over rows of the products of centred components, not divided by their number.

    Each partition gives its sums of x and of x x'; d (d + 1) numbers a partition are added up.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, xx = 0, None, None
        for b in batches:
            if len(b):
                x = np.stack(b[v].to_numpy()).astype(np.float64)
                n, s, xx = n + len(x), (0 if s is None else s) + x.sum(axis=0), (0 if xx is None else xx) + x.T @ x
        if n:
            d = len(s)
            i, j = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({"i": i, "j": j, "xx": xx.ravel(), "si": s[i], "sj": s[j], "n": n})

    sums = df.select(v).mapInPandas(part, "i int, j int, xx double, si double, sj double, n long").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xx", "si", "sj", "n")])
    return sums.select("i", "j", (F.col("xx") - F.col("si") * F.col("sj") / F.col("n")).alias("s"))


def _dense(rows: list, d: int) -> np.ndarray:
    m = np.zeros((d, d))
    for r in rows:
        m[r.i, r.j] = r.s
    return m


def top_eigenvectors(sums: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The `dims` largest eigenvalues of a matrix (i, j, s), and their vectors as columns. Of the two directions that an
    eigenvector has, that whose largest component is positive. Collects d x d numbers."""
    rows = sums.collect()
    values, vectors = np.linalg.eigh(_dense(rows, 1 + max((r.i for r in rows), default=-1)))
    top = np.argsort(-values)[:dims]
    w = vectors[:, top]
    return values[top], w * np.sign(w[np.abs(w).argmax(axis=0), np.arange(len(top))]) if len(top) else w


def pca_fit(df: DataFrame, dims: int, v: str = "v", eps: float = 1e-7) -> tuple[list[float], list[list[float]]]:
    """Mean and whitening matrix (a row for each kept direction); collects d x d numbers."""
    mean = [r["mean"] for r in mean_vector(df, v).orderBy("dim").collect()]
    values, w = top_eigenvectors(scatter(df, v), dims)
    return mean, (w / np.sqrt(np.maximum(values, 0) + eps)).T.tolist()


def itq_fit(df: DataFrame, bits: int, v: str = "v", rounds: int = 50, seed: int = 0) -> list[list[float]]:
    """Rotated projection to `bits` (a row a bit), for vectors as they are: neither here nor in use are they centred or whitened.

    The projection is onto the top eigenvectors of the covariance; then, round by round, the rotation is taken anew from
    the singular vectors of sign(x r)' x, where a sign of zero counts as one. A round needs only that sum, gathered by partition.
    """
    df = df.where(F.col(v).isNotNull()).select(v)
    _, every = top_eigenvectors(scatter(df, v), bits)
    r = np.linalg.svd(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds if every.size else 0):
        spec = df.sparkSession.sparkContext.broadcast((every, r))

        def part(batches: Iterator[pd.DataFrame], spec=spec) -> Iterator[pd.DataFrame]:
            p, q = spec.value
            total = np.zeros((bits, bits))
            for b in batches:
                if len(b):
                    y = np.stack(b[v].to_numpy()) @ p
                    total += np.where(y @ q >= 0, 1.0, -1.0).T @ y
            i, j = np.divmod(np.arange(total.size), bits)
            yield pd.DataFrame({"i": i, "j": j, "s": total.ravel()})

        sums = df.mapInPandas(part, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
        u, _, vt = np.linalg.svd(_dense(sums, bits))
        r = vt @ u.T
    return (every @ r).T.tolist() if every.size else []


def info_nce(cells: DataFrame, temperature: float = 0.07) -> DataFrame:
    """One row, loss, of cells (i, j, s, y): each item's matches but itself against the sum over its non-matches."""
    e = F.exp(F.col("s") / temperature)
    out = cells.select("i", "j", "y", e.alias("e"))
    neg = out.groupBy("i").agg((F.sum(F.when(F.col("y") == 0, F.col("e")).otherwise(0.0)) + 1e-6).alias("neg"))
    pos = out.where("y <> 0 and i <> j").join(neg, "i").groupBy("i").agg(F.avg(-F.log(F.col("e") / (F.col("e") + F.col("neg")))).alias("l"))
    return pos.agg(F.avg("l").alias("loss"))


def hard_negative_loss(cells: DataFrame, eps: float = 1e-3) -> DataFrame:
    """One row: hardneg (of each item's best non-match) and self (of the diagonal)."""
    worst = F.max(F.when(F.col("y") == 0, F.col("s")).otherwise(-100.0))
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("s")))
    by = cells.groupBy("i").agg(worst.alias("w"), own.alias("o"))
    return by.agg(F.avg(-F.log(F.greatest(1 - F.col("w"), F.lit(eps)))).alias("hardneg"), F.avg(-F.log(F.greatest("o", F.lit(eps)))).alias("self"))


def regularization_loss(cells: DataFrame, least: float = -1.0, most: float = 1.0) -> DataFrame:
    """One row, loss: how far similarities leave the range, summed."""
    over = F.greatest(F.lit(least) - F.col("s"), F.lit(0.0)) + F.greatest(F.col("s") - F.lit(most), F.lit(0.0))
    return cells.agg(F.sum(over).alias("loss"))


def batch_cells(items: DataFrame) -> DataFrame:
    """i, j, s, y of all pairs within each batch of items (batch, video_id, v, label): the product of their vectors, one matrix product
    a batch, and whether their labels are equal (0 where one is null). Batches are bounded, as in training."""
    kind = items.schema["video_id"].dataType.simpleString()
    item = F.struct("video_id", F.col("v").cast("array<double>").alias("v"), F.dense_rank().over(Window.partitionBy("batch").orderBy("label")).alias("class"), F.col("label").isNull().alias("none"))
    batches = items.withColumn("item", item).groupBy("batch").agg(F.collect_list("item").alias("items"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for one in b.column(0):
                x, ids = one.values, one.values.field("video_id")
                m = x.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                of, none = x.field("class").to_numpy(), x.field("none").to_numpy(zero_copy_only=False)
                i, j = np.divmod(np.arange(len(x) ** 2), len(x))
                same = (of[i] == of[j]) & ~none[i] & ~none[j]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array((m @ m.T).ravel()), pa.array(same.astype(np.int32))], ["i", "j", "s", "y"])

    return batches.select("items").mapInArrow(run, f"i {kind}, j {kind}, s double, y int")


def vlad(frames: DataFrame, centroids: np.ndarray, mask: str | None = None, reduction: np.ndarray | None = None, layer_norm: bool = True, weights: np.ndarray | None = None, eps: float = 1e-5) -> DataFrame:
    """video_id and f of frames (video_id, f; any number of regions): each vector is shared among the centroids (a row each) by the
    softmax of its products with `weights` (the centroids themselves if None); a cluster is the sum of its shares'
    residuals, of length 1; all clusters together have length 1; then `reduction` (a row for each output) and a layer norm
    without parameters.

    Rows where column `mask` is 0, false or null take no part; a video of such rows alone has none. Matrices are a model's,
    so they go to every task. A batch gives one row for each of its videos.
    """
    c = np.asarray(centroids, dtype=np.float64)
    spec = frames.sparkSession.sparkContext.broadcast((c, c if weights is None else np.asarray(weights, dtype=np.float64), reduction))
    kept = frames.where(F.col("f").isNotNull())
    kept = kept.where(F.col(mask).cast("int") != 0) if mask else kept
    kind = frames.schema["video_id"].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, w, _ = spec.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            e = x @ w.T
            share = np.exp(e - e.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            video = b.column(0).to_pandas()
            order = np.argsort(group := video.groupby(video, sort=False, dropna=False).ngroup().to_numpy(), kind="stable")
            begin = np.flatnonzero(np.diff(group[order], prepend=-1))
            out = [(share[rows].T @ x[rows] - share[rows].sum(axis=0)[:, None] * centres).ravel() for rows in np.split(order, begin[1:])]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * centres.size, pa.int32()), pa.array(np.concatenate(out)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(order[begin])), lists], ["video_id", "r"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _, reduce = spec.value
        for b in batches:
            out = []
            for parts in b.column(1):
                r = parts.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, *centres.shape).sum(axis=0)
                r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
                f = r.ravel() / max(np.linalg.norm(r), 1e-12)
                f = f if reduce is None else np.asarray(reduce) @ f
                out.append((f - f.mean()) / np.sqrt(f.var() + eps) if layer_norm else f)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.tolist() for f in out], pa.list_(pa.float64()))], ["video_id", "f"])

    parts = kept.select("video_id", F.col("f").cast("array<double>").alias("f")).mapInArrow(part, f"video_id {kind}, r array<double>")
    return parts.groupBy("video_id").agg(F.collect_list("r").alias("r")).mapInArrow(finish, f"video_id {kind}, f array<double>")


def save_matrices(spark: SparkSession, path: str, matrices: dict[str, list[list[float]]]) -> None:
    """Named matrices (a mean is one of a single row) as a table of their rows."""
    rows = [(name, i, [float(x) for x in row]) for name, m in matrices.items() for i, row in enumerate(m)]
    spark.createDataFrame(rows, "name string, row int, x array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_matrices(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """What `save_matrices` wrote; whole, as a model's matrices are small."""
    found: dict[str, list] = {}
    for r in spark.read.parquet(path).orderBy("name", "row").collect():
        found.setdefault(r["name"], []).append(r["x"])
    return {name: np.array(m) for name, m in found.items()}


def projected(df: DataFrame, matrix: np.ndarray, mean: np.ndarray | None = None, v: str = "v", out: str = "projected") -> DataFrame:
    """All columns and `out`: the matrix (a row a direction) times each vector, less `mean` first; null for null. The matrix is
    broadcast, and a batch is one product."""
    spec = df.sparkSession.sparkContext.broadcast((np.asarray(matrix, dtype=np.float64), None if mean is None else np.asarray(mean, dtype=np.float64).ravel()))
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), df[f"`{v}`"].cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, zero = spec.value
        for b in batches:
            given = b.column(1)
            there = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False))
            found: list = [None] * b.num_rows
            if len(there):
                x = given.flatten().to_numpy(zero_copy_only=False).reshape(len(there), -1)
                for i, y in zip(there, ((x if zero is None else x - zero) @ m.T).tolist()):
                    found[i] = y
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float64()))], ["row", "y"])

    schema = StructType([rows.schema["row"], StructField("y", ArrayType(DoubleType()))])
    return rows.mapInArrow(run, schema).select("row.*", F.col("y").alias(out))
