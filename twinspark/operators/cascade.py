"""The duplicate search: hash matches, filtered vector top-k, frame-by-frame re-ranking, thresholds. Many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspark.operators.chamfer import rerank
from twinspark.operators.similarity import grid, hamming_pairs, topk


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 50
    threshold: float = 0.8
    max_distance: int = 5
    #: Queries with hash matches give those alone.
    hash_only: bool = False
    #: Candidates from here up aren't re-ranked; of the others so many are, in the order of candidates.
    skip_from: float = 0.95
    rerank_most: int = 10
    min_frames: int = 4
    metric: str = "cosine"


def search(queries: DataFrame, index: DataFrame, hashes: DataFrame | None = None, query_hashes: DataFrame | None = None, frames: DataFrame | None = None, options: SearchOptions = SearchOptions(), groups: list[str] | None = None) -> DataFrame:
    """query_id, video_id, score (4 decimals), phash_only, rank.

    `queries` (query_id, v and `groups`), `index` (video_id, v and `groups`); `query_hashes` and `hashes` (video_id, h);
    `frames` (video_id, frame_idx, f) of both sides. Candidates are the top-k at half the threshold, then hash matches
    that are not among them; without frames they only meet the threshold. Scores are on the grid of `similarity` before they
    are compared (not rounded), so order and thresholds don't depend on the shape of batches.
    """
    o = options
    matches = hamming_pairs(query_hashes, hashes, o.max_distance).select("query_id", "video_id", "score") if hashes is not None else None
    early = None
    if o.hash_only and matches is not None:
        early = matches.where(grid(F.col("score")) >= grid(F.lit(o.threshold))).withColumn("phash_only", F.lit(True))
        queries = queries.join(matches.select("query_id").distinct(), "query_id", "left_anti")
    stage1 = topk(queries, index, o.top_k, o.metric, groups=groups)
    cand = stage1.where(grid(F.col("score")) >= grid(F.lit(o.threshold * 0.5))).select("query_id", "video_id", "score", F.lit(0).alias("late"), F.lit(False).alias("phash_only"))
    if matches is not None:
        late = matches.join(cand.select("query_id", "video_id"), ["query_id", "video_id"], "left_anti").join(queries.select("query_id"), "query_id", "left_semi")
        in_stage1 = stage1.select("query_id", "video_id", F.lit(True).alias("s1"))
        late = late.join(in_stage1, ["query_id", "video_id"], "left").select("query_id", "video_id", "score", F.lit(1).alias("late"), F.col("s1").isNull().alias("phash_only"))
        cand = cand.unionByName(late)
    if frames is not None:
        sure = cand.where(grid(F.col("score")) >= grid(F.lit(o.skip_from)))
        w = Window.partitionBy("query_id").orderBy("late", F.desc(grid(F.col("score"))), "video_id")
        rest = cand.where(grid(F.col("score")) < grid(F.lit(o.skip_from))).withColumn("n", F.row_number().over(w)).where(F.col("n") <= o.rerank_most).drop("n")
        again = rerank(rest, frames, min_frames=o.min_frames)
        cand = sure.unionByName(rest.drop("score").join(again, ["query_id", "video_id"]).select(*cand.columns))
    found = cand.where(grid(F.col("score")) >= grid(F.lit(o.threshold))).select("query_id", "video_id", "score", "phash_only")
    if early is not None:
        found = found.unionByName(early)
    w = Window.partitionBy("query_id").orderBy(F.desc(grid(F.col("score"))), "video_id")
    return found.withColumn("rank", F.row_number().over(w)).withColumn("score", F.round("score", 4))
