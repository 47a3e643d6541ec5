"""Media files and frames as sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from twinspark.functions.scalar import VIDEO_SUFFIXES, stem, suffix


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime and video_id (the stem) of the files under `path`; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime", stem(F.col("path")).alias("video_id"))


def distinct_media(files: DataFrame, suffixes: tuple[str, ...] = VIDEO_SUFFIXES) -> DataFrame:
    """Files (path, real_path, length) with a media suffix, not hidden, not empty; of each real path the least path."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kept = files.where((F.col("length") > 0) & ~name.startswith(".") & suffix(F.col("path")).isin(*suffixes))
    w = Window.partitionBy("real_path").orderBy("path")
    return kept.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def decoded(files: DataFrame, decode: Callable[[bytes], list], schema: str = "path string, frame_idx int, pixels binary") -> DataFrame:
    """A row for each frame that `decode` yields from a file's content; files that fail give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content):
                try:
                    frames = decode(content)
                except Exception:  # a damaged file must not end the job
                    continue
                if len(frames):
                    yield pd.DataFrame({"path": path, "frame_idx": range(len(frames)), "pixels": frames})

    return files.select("path", "content").mapInPandas(run, schema)


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """path, video_id (the folder) and frame_idx of numbered pictures like 00012.jpg."""
    f = listed(spark, path, "*.jpg")
    return f.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video_id"), F.regexp_extract("path", r"(\d+)\.jpg$", 1).try_cast("int").alias("frame_idx")).where("frame_idx is not null")


def perceptual_hash(grey: "list[float] | pd.Series", size: int = 32, keep: int = 8) -> int:
    """64-bit hash of a size x size grey picture: low frequencies of its cosine transform over their median, row by row."""
    import numpy as np

    x = np.asarray(grey, dtype=np.float64).reshape(size, size)
    k = np.arange(size)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * size))
    low = (basis @ x @ basis.T)[:keep, :keep]
    bits = (low > np.median(low)).ravel()
    h = int("".join("1" if b else "0" for b in bits), 2)
    return h - (1 << 64) if h >> 63 else h


def hashed_pictures(df: DataFrame, grey: str = "grey") -> DataFrame:
    """`df` with h, the perceptual hash of ARRAY<DOUBLE> column `grey` of 32 x 32 values; null for other sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [perceptual_hash(v) if v is not None and len(v) == 1024 and None not in v else None for v in b.column(b.schema.get_field_index(grey)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h, pa.int64())], [*b.schema.names, "h"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("h", LongType())]))
