"""Tables sorted by a key, for pages and point reads.

Rows are dealt by ranges of the key and sorted within files, with a Bloom filter on the key, so that Parquet's own
statistics prune; beside them stands a table of the ranges (least key, greatest key, rows). A page takes its upper end from
there, so that the scan has both ends of the key and takes in the ranges between them alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SortedTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "video_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def write(self, df: DataFrame, rows: int = 1_000_000) -> None:
        """In ranges of about `rows` rows. Rows with a null key are in the first range; no page and no key has them. Equal keys
        share a range."""
        parts = max(1, -(-df.count() // rows))
        ranged = df.repartitionByRange(parts, self.key).sortWithinPartitions(self.key)
        ranged.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.path}/rows")
        stored = self.rows()
        bounds = stored.where(F.col(self.key).isNotNull()).groupBy(F.col("_metadata.file_path").alias("file"))
        bounds = bounds.agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("n"))
        bounds.repartitionByRange(max(1, parts // 100_000), "low").sortWithinPartitions("low").write.mode("overwrite").parquet(f"{self.path}/ranges")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def page_after(self, cursor=None, limit: int = 20) -> DataFrame:
        """The next `limit` (1 to 100) rows by key after `cursor` (None: from the first)."""
        limit = min(100, max(1, limit))
        ranges = self.spark.read.parquet(f"{self.path}/ranges")
        ranges = ranges if cursor is None else ranges.where(F.col("high") > cursor)
        # the first range may have any number of rows after the cursor, each further one has a row at least
        ahead, high, sure = ranges.orderBy("low").limit(limit + 1).collect(), None, 0
        for i, r in enumerate(ahead):
            high, sure = r["high"], sure + (r["n"] if i or cursor is None else 0)
            if sure >= limit:
                break
        found = self.rows().where(F.col(self.key).isNotNull())
        found = found if cursor is None else found.where(F.col(self.key) > cursor)
        return (found.where(F.col(self.key) <= high) if high is not None else found.limit(0)).orderBy(self.key).limit(limit)

    def get(self, value) -> DataFrame:
        """The rows of one key; KeyError if there is none."""
        found = self.rows().where(F.col(self.key) == value)
        if found.isEmpty():
            raise KeyError(value)
        return found
