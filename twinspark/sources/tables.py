"""Inputs of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.functions.vector import doubles, sign_bits


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id and its vector."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("video_id"), doubles(F.col("embedding")).alias("v"), "label")


SQL_DESCRIPTORS = "desc_ AS (SELECT vec_id AS video_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id and a 64-bit hash: the signs of its vector."""
    return descriptors(spark, sf_dir).select("video_id", sign_bits(F.col("v")).alias("h"))


SQL_HASHES = "hash_ AS (SELECT vec_id AS video_id, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(2 ** i AS HUGEINT) ELSE CAST(0 AS HUGEINT) END)) AS UBIGINT) AS h FROM embeddings)"


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, duration, width and height; null where the source has no row."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("video_id"))
    v = read(spark, sf_dir, "events").select(F.col("event_id").alias("video_id"), F.col("value").alias("duration"), (40 * (1 + F.col("user_id") % 40)).alias("height"), "ts")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"), (40 * F.col("p_size")).alias("width"), F.col("p_name").alias("name"))
    return e.join(v, "video_id", "left").join(p, "video_id", "left")


SQL_VIDEOS = "video_ AS (SELECT vec_id AS video_id, value AS duration, 40 * (1 + user_id % 40) AS height, ts, 40 * p_size AS width, p_name AS name FROM embeddings LEFT JOIN events ON event_id = vec_id LEFT JOIN part ON p_partkey = vec_id)"
SQL_BUCKET = "CASE WHEN duration IS NULL OR duration <= 0 THEN 'unknown' WHEN duration <= 10 THEN '0-10s' WHEN duration <= 30 THEN '10-30s' WHEN duration <= 60 THEN '30-60s' WHEN duration <= 300 THEN '1-5m' WHEN duration <= 1800 THEN '5-30m' ELSE '30m+' END"
SQL_ASPECT = "CASE WHEN width IS NULL OR height IS NULL OR width <= 0 OR height <= 0 THEN 'unknown' WHEN CAST(width AS DOUBLE) / height > 1.2 THEN 'landscape' WHEN CAST(width AS DOUBLE) / height < 0.8 THEN 'portrait' ELSE 'square' END"


def frames(spark: SparkSession, sf_dir: str, regions: int = 4) -> DataFrame:
    """video_id, frame_idx, region_idx and f: ten vectors are a video, each cut into regions."""
    e = read(spark, sf_dir, "embeddings")
    width = 64 // regions
    f = F.transform(F.sequence(F.lit(0), F.lit(regions - 1)), lambda r: F.slice(doubles(F.col("embedding")), r * width + 1, F.lit(width)))
    return e.select(F.floor(F.col("vec_id") / 10).alias("video_id"), (F.col("vec_id") % 10).alias("frame_idx"), F.posexplode(f).alias("region_idx", "f"))


SQL_FRAMES = "frame_ AS (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS video_id, vec_id % 10 AS frame_idx, r AS region_idx, list_slice(CAST(embedding AS DOUBLE[]), r * 16 + 1, r * 16 + 16) AS f FROM embeddings, unnest(range(4)) AS t(r))"
SQL_FRAMES1 = "frame_ AS (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS video_id, vec_id % 10 AS frame_idx, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, real_path and length: what a listing of files gives."""
    p = read(spark, sf_dir, "pages")
    kind = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".MKV", ".txt", "", ".webm")]), (F.col("page_id") % 5 + 1).cast("int"))
    name = F.concat(F.when(F.col("page_id") % 7 == 0, ".").otherwise(""), F.lit("clip_"), F.col("page_id").cast("string"), F.lit("_"), F.substring(F.md5("url"), 1, 8), kind)
    return p.select(F.concat(F.lit("/v/"), (F.col("page_id") % 3).cast("string"), F.lit("/"), name).alias("path"), F.concat(F.lit("/real/"), F.floor(F.col("page_id") / 2).cast("string")).alias("real_path"), F.when(F.col("page_id") % 11 == 0, 0).otherwise(F.length("html")).cast("long").alias("length"))


SQL_FILES = "file_ AS (SELECT '/v/' || (page_id % 3) || '/' || CASE WHEN page_id % 7 = 0 THEN '.' ELSE '' END || 'clip_' || page_id || '_' || left(md5(url), 8) || ['.mp4', '.MKV', '.txt', '', '.webm'][page_id % 5 + 1] AS path, '/real/' || CAST(floor(page_id / 2) AS BIGINT) AS real_path, CAST(CASE WHEN page_id % 11 = 0 THEN 0 ELSE length(html) END AS BIGINT) AS length FROM pages)"
