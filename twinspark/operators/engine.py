"""What a user calls: build an index, search it, group duplicates, evaluate, keep the table."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.functions.scalar import aspect_class, duration_bucket, hash_number, hash_text
from twinspark.operators import catalog, grouping
from twinspark.operators.cascade import SearchOptions, search
from twinspark.operators.pooling import descriptor
from twinspark.operators.similarity import similar_pairs

SCHEMA = (
    "video_id string, path string, width int, height int, codec string, duration double, bitrate bigint, fps double, "
    "duration_bucket string, aspect_ratio string, phash string, added_at timestamp, extra map<string,string>, v array<double>"
)


@dataclass(frozen=True)
class Config:
    """Options with their defaults; `load` puts saved ones over them, unknown keys left out."""

    backend: str = "table"
    dim: int = 512
    threshold: float = 0.8
    top_k: int = 50
    top_n: int = 10
    max_distance: int = 5
    hash_only: bool = False
    max_frames: int = 60
    fps: float = 1.0
    resize: int = 256
    crop: int = 224
    cache_ttl: int = 86_400
    cache_most: int = 100

    @classmethod
    def load(cls, saved: str | None) -> Config:
        known = {k: v for k, v in json.loads(saved or "{}").items() if k in asdict(cls())}
        return replace(cls(), **known)

    def saved(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def merged(saved: Column, *names: str) -> list[Column]:
    """Options of a column of saved configurations (JSON): what is saved, else the default; unknown keys are left out."""
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    options = {n: v for n, v in asdict(Config()).items() if n in (names or asdict(Config()))}
    read = F.from_json(saved, ", ".join(f"{n} {kinds[type(v)]}" for n, v in options.items()))
    return [F.coalesce(read[n], F.lit(v)).alias(n) for n, v in options.items()]


def payload(videos: DataFrame) -> DataFrame:
    """Rows of the table from any columns of it: missing ones null, buckets and hash text derived."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = dict(x.split(" ", 1) for x in SCHEMA.split(", "))
    df = videos
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast(types[n]))
    df = df.withColumn("duration_bucket", duration_bucket(F.col("duration"))).withColumn("aspect_ratio", aspect_class(F.col("width"), F.col("height")))
    return df.select(*[F.col(n).cast(types[n]).alias(n) for n in names])


class Engine:
    """A table of videos with their vectors and hashes, and a table of frame features."""

    def __init__(self, spark: SparkSession, path: str, config: Config = Config()):
        self.spark, self.config = spark, config
        self.videos = catalog.VideoTable(spark, f"{path}/videos", SCHEMA)
        self.frames = catalog.VideoTable(spark, f"{path}/frames", "video_id string, frame_idx bigint, region_idx bigint, f array<double>", ())

    def add(self, videos: DataFrame, frames: DataFrame | None = None) -> None:
        """Upsert videos; vectors come from `frames` (with regions: pooled) where `videos` has none. All regions of a frame are
        kept, and re-ranking compares them all; frames without regions have one."""
        if frames is not None and "v" not in videos.columns:
            videos = videos.join(descriptor(frames), "video_id", "left")
        self.videos.upsert(payload(videos))
        if frames is not None:
            region = F.col("region_idx") if "region_idx" in frames.columns else F.lit(0)
            self.frames.upsert(frames.select(F.col("video_id").cast("string"), F.col("frame_idx").cast("long"), region.cast("long").alias("region_idx"), "f"))

    def resume(self, files: DataFrame) -> DataFrame:
        """Files (video_id, ...) that the table doesn't have."""
        return files.join(self.videos.current().select("video_id"), "video_id", "left_anti")

    def search(self, queries: DataFrame, options: SearchOptions | None = None, rerank: bool = True) -> DataFrame:
        """Matches of `queries` (rows as of the table) with the metadata of each."""
        c, index = self.config, self.videos.current()
        o = options or SearchOptions(top_k=c.top_k, threshold=c.threshold, max_distance=c.max_distance, hash_only=c.hash_only)
        q = payload(queries).withColumnRenamed("video_id", "query_id")
        with_hash = lambda df, key: df.select(F.col(key).alias("video_id"), hash_number(F.col("phash")).alias("h")).where("h is not null")
        frames = self.frames.current() if rerank else None
        found = search(q.where("v is not null"), self._pruned(index, q).where("v is not null"), with_hash(index, "video_id"), with_hash(q, "query_id"), frames, o, ["duration_bucket", "aspect_ratio"])
        return found.join(index.drop("v"), "video_id", "left")

    def _pruned(self, index: DataFrame, queries: DataFrame) -> DataFrame:
        """`index` without the partitions that no query's buckets allow; a query of unknown bucket allows all."""
        for c in ("duration_bucket", "aspect_ratio"):
            wanted = [r[0] for r in queries.select(c).distinct().collect()]  # a handful of names
            if wanted and "unknown" not in wanted:
                index = index.where(F.col(c).isin(*wanted))
        return index

    def duplicates(self, threshold: float | None = None, top_k: int | None = None) -> DataFrame:
        """Greedy groups: group_id, video_id, place."""
        v = self.videos.current().where("v is not null").select("video_id", "v")
        return grouping.greedy_groups(similar_pairs(v, threshold or self.config.threshold, "cosine", top_k or self.config.top_k))

    def page(self, cursor: str | None = None, limit: int = 20) -> tuple[DataFrame, str | None]:
        return catalog.page_at(self.videos.current().drop("v"), cursor, limit)

    def get(self, video_id: str) -> DataFrame:
        return catalog.get(self.videos.current(), video_id)

    def delete(self, ids: DataFrame) -> None:
        """From both tables; KeyError for ids that there aren't."""
        self.videos.delete(ids)
        self.frames.delete(ids, must_exist=False)

    def delete_all(self) -> int:
        self.frames.delete_all()
        return self.videos.delete_all()

    def status(self) -> DataFrame:
        return self.videos.current().agg(F.count("*").alias("videos"), F.count("v").alias("vectors"), F.count("phash").alias("hashes"))


def results_json(found: DataFrame) -> DataFrame:
    """A line of JSON for each match: id, score of four decimals, path where there is one."""
    return found.select(F.to_json(F.struct("video_id", F.round("score", 4).alias("score"), "path")).alias("line"))


def with_hash_text(df: DataFrame, h: str = "h") -> DataFrame:
    return df.withColumn("phash", hash_text(F.col(h)))
