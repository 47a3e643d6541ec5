"""Cells of a vector space: k-means centres fitted on a bounded sample, and what bounds they give.

Every row of a table is in the cell of its nearest centre. `VectorIndex` keeps a table by cell, so that a search reads the
cells it probes; `tiles` and `partners` cut a table into pieces of bounded size with a centre and a radius each, so that
pairs of pieces whose scores can't reach a threshold are never met.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.operators.similarity import BROADCAST_VALUES, KEPT, blocks, on_grid, parts, ranked, unit_rows

#: Sampled rows a cell that centres are fitted on, numbers in the whole sample, and rounds of the fit.
SAMPLE, SAMPLE_VALUES, ROUNDS = 64, 32_000_000, 10
#: Most cells of an index (its centres go to every task), and of tiles, which are cut further.
MOST_CELLS, TILE_CELLS = 65_536, 1_024


def fit(df: DataFrame, cells: int, metric: str = "cosine", seed: int = 0) -> np.ndarray:
    """Centres from about `SAMPLE` rows a cell, drawn by a hash of the id; fewer rows than cells give as many centres. The
    sample alone reaches the driver, whatever the table's size."""
    given = df.where(F.col("v").isNotNull()).select("video_id", "v")
    n, dim = given.count(), len((given.first() or {"v": [0]})["v"])
    rows = max(cells, min(cells * SAMPLE, SAMPLE_VALUES // dim))
    share = min(1.0, 1.1 * rows / max(1, n))
    drawn = given.where(F.pmod(F.xxhash64("video_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * rows).toPandas()
    if not len(drawn):
        return np.zeros((0, 0))
    x = unit_rows(drawn.sort_values("video_id").v, metric)
    rng = np.random.default_rng(seed)
    centres = np.unique(x[rng.permutation(len(x))[:cells]], axis=0)
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        found, begin, size = np.unique(own[order], return_index=True, return_counts=True)
        centres[found] = np.add.reduceat(x[order], begin, axis=0) / size[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Number of each row's nearest centre, or the k nearest by rising distance."""
    squares, out = (centres**2).sum(axis=1), []
    for at in range(0, len(x), 4096):
        d = squares - 2 * (x[at : at + 4096] @ centres.T)
        out.append(d.argmin(axis=1) if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :k])
    return np.concatenate(out)


def dealt(df: DataFrame, centres: np.ndarray, metric: str = "cosine") -> DataFrame:
    """All columns, cell, and away: the distance to its centre."""
    spec = df.sparkSession.sparkContext.broadcast(centres)  # cells are bounded by a parameter
    at = df.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _rows(b.column(at), metric)
                own = nearest(x, spec.value)
                away = np.sqrt(((x - spec.value[own]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(away)], [*b.schema.names, "cell", "away"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.where(F.col("v").isNotNull()).mapInArrow(run, f"{ddl}, cell int, away double")


def _rows(v: pa.ListArray, metric: str) -> np.ndarray:
    m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if metric == "cosine" else m


class VectorIndex:
    """A table of (video_id, v) in a folder, partitioned by cell, with the centres and each cell's radius beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, df: DataFrame, cells: int, metric: str = "cosine") -> None:
        """Deal all rows into cells and write them; null vectors take no part. A cell may be several files."""
        if cells > MOST_CELLS:
            raise ValueError(f"at most {MOST_CELLS} cells")
        centres = fit(df, cells, metric)
        rows = df.select("video_id", F.col("v").cast("array<double>").alias("v"))
        if len(centres):
            rows = dealt(rows, centres, metric)
        else:
            rows = rows.limit(0).select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("away"))
        rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows")
        kind = df.schema["video_id"].dataType.simpleString()
        sizes = self._read(kind).groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row a cell
        found = {r["cell"]: (r["n"], r["radius"]) for r in sizes}
        meta = [(i, c.tolist(), *found.get(i, (0, 0.0)), json.dumps({"metric": metric, "id": kind})) for i, c in enumerate(centres)]
        self.spark.createDataFrame(meta, "cell int, centre array<double>, n long, radius double, about string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(f"video_id {kind}, v array<double>, away double, cell int").parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, probes: int | None = 8, exact: bool = False) -> DataFrame:
        """query_id, video_id, score, rank: k of the best for each of `queries` (query_id, v), from the `probes` nearest cells.

        With `exact` the k-th score found there is held against what a cell can hold at most, q c + |q| r for its centre and
        radius, and cells that may hold better are read as well: the result is that of `similarity.topk`. Queries pass
        in blocks of bounded size; each block reads the partitions of its cells alone.
        """
        cells = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # a row a cell
        found = None
        about = json.loads(cells[0]["about"]) if cells else {"metric": "dot", "id": "long"}
        centres = np.array([r["centre"] for r in cells])
        radius = np.array([r["radius"] for r in cells])
        filled = np.array([r["n"] > 0 for r in cells], bool)
        # a block's vectors are bounded, and so is its matrix of queries and cells
        for block in blocks(queries.where(F.col("v").isNotNull()).select("query_id", "v"), "query_id", max(centres.shape) if len(centres) else 1):
            if not len(block) or not filled.any():
                continue
            q, ids = unit_rows(block.v, about["metric"]), block.query_id.to_numpy()
            wanted = np.zeros((len(q), len(centres)), bool)
            np.put_along_axis(wanted, nearest(q, centres, max(2, min(probes or len(centres), len(centres))))[:, : probes or None], True, axis=1)
            wanted &= filled
            hits = self._probed(queries.schema["query_id"].dataType.simpleString(), about, ids, q, wanted, k)
            if exact:
                first = ranked(hits, k).toPandas()  # k rows a query of the block
                floor = pd.Series(-np.inf, index=pd.Index(ids))
                full = first[first["rank"] == k]
                floor[full.query_id.to_numpy()] = full.score.to_numpy()
                most = q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * radius
                more = (on_grid(most) + 1 >= on_grid(floor[ids].to_numpy())[:, None]) & filled & ~wanted
                hits = self.spark.createDataFrame(first[["query_id", "video_id", "score"]], hits.schema) if len(first) else hits.limit(0)
                if more.any():
                    hits = hits.unionByName(self._probed(queries.schema["query_id"].dataType.simpleString(), about, ids, q, more, k, on_grid(floor[ids].to_numpy())))
            found = hits if found is None else found.unionByName(hits)
        if found is None:
            found = self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, video_id {about['id']}, score double")
        return ranked(found, k)

    def _probed(self, query_kind: str, about: dict, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int, floor: np.ndarray | None = None) -> DataFrame:
        """Each query's k best of each task's share of its cells, none under its `floor` (a place on the grid)."""
        spec = self.spark.sparkContext.broadcast((ids, q, wanted, np.full(len(ids), -np.inf) if floor is None else floor))
        cells = [int(c) for c in np.flatnonzero(wanted.any(axis=0))]
        rows = self._read(about["id"]).where(F.col("cell").isin(cells)).select("video_id", "v", "cell")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            own, m, want, least = spec.value
            best: list[pd.DataFrame] = []
            for b in batches:
                if not b.num_rows:
                    continue
                x, cell, other = _rows(b.column(1), about["metric"]), b.column(2).to_numpy(), b.column(0).to_pandas().to_numpy()
                for c in np.unique(cell):
                    here, every = np.flatnonzero(cell == c), np.flatnonzero(want[:, c])
                    for asks in (every[part] for _, part in parts(len(every), len(here))):
                        s = m[asks] @ x[here].T
                        g = on_grid(s)
                        cut = least[asks][:, None]
                        if g.shape[1] > k:
                            cut = np.maximum(cut, np.partition(g, g.shape[1] - k, axis=1)[:, g.shape[1] - k, None])
                        i, j = np.nonzero(g >= cut)
                        best.append(pd.DataFrame({"query_id": own[asks[i]], "video_id": other[here[j]], "score": s[i, j]}))
                        if sum(map(len, best)) > 2 * KEPT:
                            best = [_trimmed(best, k)]
            if best:
                yield pa.RecordBatch.from_pandas(_trimmed(best, k), preserve_index=False)

        return rows.mapInArrow(run, f"query_id {query_kind}, video_id {about['id']}, score double")


def _trimmed(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    every = pd.concat(parts)
    every = every.assign(grid=-on_grid(every.score.to_numpy())).sort_values(["query_id", "grid", "video_id"]).drop(columns="grid")
    return every.groupby("query_id", sort=False).head(k)


def tiles(index: DataFrame, rows: int, metric: str) -> DataFrame:
    """tile, items (video_id, v), centre and radius: a table in pieces of about `rows` rows, near ones together. A cell of more
    rows is cut by a hash of the id, so a cell that holds most of the table is many tiles."""
    given = index.where(F.col("v").isNotNull()).select("video_id", F.col("v").cast("array<double>").alias("v"))
    cells = min(TILE_CELLS, max(1, -(-given.count() // rows)))
    centres = fit(given, cells, metric)
    if not len(centres):
        return given.sparkSession.createDataFrame([], f"tile int, items array<struct<video_id:{given.schema['video_id'].dataType.simpleString()},v:array<double>>>, centre array<double>, radius double")
    placed = dealt(given, centres, metric).drop("away")
    sizes = placed.groupBy("cell").count().orderBy("cell").collect()  # a row a cell
    parts, first = {}, 0
    for r in sizes:
        parts[r["cell"]] = (first, n := max(1, -(-r["count"] // rows)))
        first += n
    table = given.sparkSession.createDataFrame([(c, a, n) for c, (a, n) in parts.items()], "cell int, first int, n int")
    tile = (F.col("first") + F.pmod(F.xxhash64("video_id"), F.col("n"))).cast("int").alias("tile")
    items = placed.join(F.broadcast(table), "cell").select(tile, F.struct("video_id", "v").alias("item")).groupBy("tile").agg(F.collect_list("item").alias("items"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                x = _rows(row.column(1).flatten().field("v"), metric)
                centre = x.mean(axis=0)
                radius = np.sqrt(((x - centre) ** 2).sum(axis=1).max())
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([centre.tolist()]), pa.array([float(radius)])], ["tile", "items", "centre", "radius"])

    return items.mapInArrow(bound, f"tile int, items {items.schema['items'].dataType.simpleString()}, centre array<double>, radius double")


def partners(tiled: DataFrame, threshold: float) -> DataFrame:
    """a and b, tiles with a <= b whose items' products may reach `threshold`: with x = c + d, |d| <= r on both sides, x y is at most
    c c' + |c| r' + |c'| r + r r'. Centres are broadcast if a count shows that they fit; else no pair is left out."""
    spark = tiled.sparkSession
    small = tiled.select("tile", "centre", "radius")
    n, dim = tiled.count(), len((small.select("centre").first() or {"centre": [0]})["centre"])
    if n * dim > BROADCAST_VALUES:
        return small.select(F.col("tile").alias("a"), F.explode(F.sequence("tile", F.lit(n - 1))).alias("b"))
    rows = small.toPandas().sort_values("tile")
    spec = spark.sparkContext.broadcast((rows.tile.to_numpy(), np.array(rows.centre.tolist()).reshape(n, -1), rows.radius.to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, c, r = spec.value
        length = np.linalg.norm(c, axis=1)
        for b in batches:
            for a in b.column(0).to_numpy():
                i = np.searchsorted(tile, a)
                most = c @ c[i] + length * r[i] + length[i] * r + r * r[i]
                meet = tile[(tile >= a) & (on_grid(most) + 1 >= on_grid(threshold))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(meet), a), pa.int32()), pa.array(meet, pa.int32())], ["a", "b"])

    return small.select("tile").mapInArrow(run, "a int, b int")
