"""Frame-to-frame similarity of video pairs.

Frames of both sides meet by pair, never all with all: `pairs` (query_id, video_id) says which videos are compared. A
video's frames are gathered into one row, pairs join those rows, and a pair is one matrix product in an Arrow batch
(`pair_scores`); its cells become rows only where they are asked for (`frame_matrix`). A video's frames are bounded, a
pair's are those of two videos.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.operators.similarity import ranked

PAIR = ["query_id", "video_id"]


def _gathered(frames: DataFrame, key: str, name: str) -> DataFrame:
    """A row for each video: its frames (frame_idx, region_idx, f) in order."""
    region = F.col("region_idx") if "region_idx" in frames.columns else F.lit(0)
    item = F.struct(F.col("frame_idx").cast("long").alias("frame_idx"), region.cast("long").alias("region_idx"), F.col("f").cast("array<double>").alias("f"))
    return frames.groupBy(F.col("video_id").alias(key)).agg(F.sort_array(F.collect_list(item)).alias(name))


def _matrix(items: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame numbers, where each frame's rows begin, and the rows of one video."""
    frame = items.field("frame_idx").to_numpy(zero_copy_only=False)
    rows = items.field("f").flatten().to_numpy(zero_copy_only=False).reshape(len(frame), -1)
    begin = np.flatnonzero(np.concatenate([[True], frame[1:] != frame[:-1]]))
    return frame[begin], begin, rows


def cell_matrix(q: pa.StructArray, t: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame numbers of both sides and the matrix of their similarities. Where frames have regions, a cell is the chamfer of
    their regions: for each of the query frame's the best of the other's, averaged."""
    (i, qb, a), (j, tb, b) = _matrix(q), _matrix(t)
    s = a @ b.T
    if len(tb) < s.shape[1]:
        s = np.maximum.reduceat(s, tb, axis=1)
    if len(qb) < s.shape[0]:
        s = np.add.reduceat(s, qb, axis=0) / np.diff(np.append(qb, len(a)))[:, None]
    return i, j, s


def _paired(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    return pairs.select(*PAIR).join(_gathered(queries, "query_id", "q"), "query_id").join(_gathered(targets, "video_id", "t"), "video_id").select(*PAIR, "q", "t")


def _ids(df: DataFrame) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in PAIR)


def frame_matrix(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, video_id, i, j, s: similarity of frame i and frame j (see `cell_matrix`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                i, j, s = cell_matrix(batch.column(2)[row].values, batch.column(3)[row].values)
                ids = [pa.repeat(batch.column(c)[row], s.size) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(s.ravel())], [*PAIR, "i", "j", "s"])

    return _paired(pairs, queries, targets).mapInArrow(run, f"{_ids(pairs)}, i long, j long, s double")


def best_mean(s: np.ndarray) -> float:
    """For each row the best, averaged."""
    return float(s.max(axis=1).mean())


def both_ways(s: np.ndarray) -> float:
    return (best_mean(s) + best_mean(s.T)) / 2


def pair_scores(pairs: DataFrame, queries: DataFrame, targets: DataFrame, score: Callable[[np.ndarray], float | None] = best_mean, normalize: bool = False) -> DataFrame:
    """query_id, video_id, score of each pair: `score` of its frame matrix, one product a pair; none where it gives None.

    `normalize` clamps similarities to [-1, 1] and shifts them to [0, 1]. Frames that are masked are left out beforehand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[float | None] = []
            for q, t in zip(batch.column(2), batch.column(3)):
                s = cell_matrix(q.values, t.values)[2]
                out.append(score(np.clip(s, -1, 1) / 2 + 0.5 if normalize else s))
            found = pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], [*PAIR, "score"])

    return _paired(pairs, queries, targets).mapInArrow(run, f"{_ids(pairs)}, score double").where("score is not null")


def chamfer(cells: DataFrame, over: str = "j", by: list[str] | None = None, score: Column | None = None) -> DataFrame:
    """Best over `over` for each frame of the other side, averaged, of cells that are rows. Masked cells are absent ones."""
    other, by = ("i" if over == "j" else "j"), by or PAIR
    best = cells.groupBy(*by, other).agg(F.max(F.col("s") if score is None else score).alias("m"))
    return best.groupBy(*by).agg(F.avg("m").alias("score"))


def chunked(chunk: int = 2048) -> Callable[[np.ndarray], float]:
    """Chamfer to each run of `chunk` target frames, averaged without regard to the runs' lengths."""
    return lambda s: float(np.mean([best_mean(s[:, at : at + chunk]) for at in range(0, s.shape[1], chunk)]))


def rerank(candidates: DataFrame, frames: DataFrame, normalize: bool = True, min_frames: int = 4, top_n: int | None = None, symmetric: bool = False) -> DataFrame:
    """query_id, video_id, score of the candidates, compared frame by frame; those without features or with too few frames drop out."""
    enough = frames.select("video_id", "frame_idx").distinct().groupBy("video_id").count().where(F.col("count") >= min_frames).select("video_id")
    kept = candidates.select(*PAIR).join(enough, "video_id", "left_semi").join(enough.withColumnRenamed("video_id", "query_id"), "query_id", "left_semi")
    out = pair_scores(kept, frames, frames, both_ways if symmetric else best_mean, normalize)
    return ranked(out, top_n).drop("rank") if top_n else out
