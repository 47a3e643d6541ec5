"""Tables of videos: changes as plans over whole tables, and tables in folders whose changes rewrite what they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key by `order`."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(base: DataFrame, new: DataFrame, key: str = "video_id") -> DataFrame:
    """`base` with the rows of `new` in place of those of equal key."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def append(base: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both, equal keys included."""
    return base.unionByName(new)


def delete(base: DataFrame, ids: DataFrame, key: str = "video_id", must_exist: bool = False) -> DataFrame:
    """`base` without the keys of `ids`; `must_exist` raises KeyError for keys that it doesn't have."""
    if must_exist and not (missing := ids.select(key).distinct().join(base.select(key), key, "left_anti").limit(1)).isEmpty():
        raise KeyError(missing.first()[0])
    return base.join(ids.select(key).distinct(), key, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str = "video_id") -> dict[str, DataFrame]:
    return {name: delete(t, ids, key) for name, t in tables.items()}


def get(base: DataFrame, value, key: str = "video_id") -> DataFrame:
    """The rows of one key; KeyError if there is none."""
    found = base.where(F.col(key) == value)
    if found.isEmpty():
        raise KeyError(value)
    return found


def page_after(base: DataFrame, cursor, limit: int, key: str = "video_id") -> DataFrame:
    """The next `limit` (1 to 100) rows by key after `cursor` (None: from the first)."""
    limit = min(100, max(1, limit))
    return (base if cursor is None else base.where(F.col(key) > cursor)).orderBy(key).limit(limit)


def page_at(base: DataFrame, cursor: str | None, limit: int, key: str = "video_id") -> tuple[DataFrame, str | None]:
    """A page by offset and the next cursor, null after the last; a bad cursor counts as 0."""
    limit = min(100, max(1, limit))
    start = int(cursor) if cursor and cursor.isdigit() else 0
    more = base.orderBy(key).offset(start).limit(limit + 1)
    return base.orderBy(key).offset(start).limit(limit), str(start + limit) if more.count() > limit else None


def cache_hits(keys: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = 86_400) -> DataFrame:
    """`keys` (sha256, model) with the cache's row where it is younger than the time to live."""
    fresh = cache.where(F.unix_micros("created_at") > F.unix_micros(now) - ttl_seconds * 1_000_000)
    return keys.join(fresh, ["sha256", "model"], "left").withColumn("hit", F.col("created_at").isNotNull())


def evicted(cache: DataFrame, most: int = 100) -> DataFrame:
    """The `most` newest rows (ties to the smaller key)."""
    return cache.orderBy(F.desc("created_at"), "sha256").limit(most)


def ingest_counts(tried: DataFrame, indexed: DataFrame, key: str = "video_id") -> DataFrame:
    """One row of what became of `tried` (key, ok, at): total, succeeded, failed, skipped (keys that `indexed` has, which are not
    tried), and rate, those that succeeded in a second of the time from the first to the last."""
    there = indexed.select(key).distinct().withColumn("old", F.lit(True))
    t = tried.join(there, key, "left").select("ok", "at", F.coalesce("old", F.lit(False)).alias("old"))
    good = F.count_if(F.col("ok") & ~F.col("old"))
    seconds = (F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 1e6
    return t.agg(F.count("*").alias("total"), good.alias("succeeded"), F.count_if(~F.col("ok") & ~F.col("old")).alias("failed"), F.count_if("old").alias("skipped"), (good / F.nullif(seconds, F.lit(0.0))).alias("rate"))


def similarity_maps(scored: DataFrame) -> DataFrame:
    """query_id and similarities, a map from video_id to score, of (query_id, video_id, score)."""
    return scored.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("video_id", "score"))).alias("similarities"))


#: Columns of a stored row: its bucket, whether it only marks its folder, and the last batch that changed the bucket.
BUCKET, MARK, BATCH = "__bucket", "__mark", "__batch"


class VideoTable:
    """A table in a folder, dealt into buckets by a hash of the key.

    A change reads and writes the buckets of its keys alone, by Spark's dynamic partition overwrite; the others' files
    stay as they are. A bucket's folder is cut further by `partitions`. As an overwrite only replaces folders that it has
    rows for, each folder that a changed bucket had keeps a row that only marks it. Marks also carry the number of the last
    batch: a change with a batch number leaves out buckets that have seen it, so that a micro-batch that is run again, after
    whatever part of it was written, changes nothing twice.

    Keys that are null are in the bucket of nulls. Changes of one table must not run at the same time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, partitions: tuple[str, ...] = ("duration_bucket", "aspect_ratio"), key: str = "video_id", buckets: int = 16):
        self.spark, self.path, self.partitions, self.key, self.buckets = spark, path.rstrip("/"), partitions, key, buckets
        self.fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        self._stored = StructType([*self.fields, StructField(MARK, BooleanType()), StructField(BATCH, LongType()), StructField(BUCKET, IntegerType())])

    def _rows(self) -> DataFrame:
        """All rows as stored."""
        top = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(top):
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(self.path)

    def _plain(self, stored: DataFrame) -> DataFrame:
        return stored.where(~F.col(MARK)).select(*[f.name for f in self.fields])

    def current(self) -> DataFrame:
        return self._plain(self._rows())

    def of_keys(self, keys: list) -> DataFrame:
        """The rows of a few keys, read from their buckets."""
        values = self.spark.createDataFrame([(k,) for k in keys], StructType([self._field()]))
        numbers = [r[0] for r in values.select(self._bucket()).distinct().collect()]
        return self._plain(self._rows().where(F.col(BUCKET).isin(numbers))).where(F.col(self.key).isin(keys))

    def _field(self) -> StructField:
        return next(f for f in self.fields if f.name == self.key)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast(self._field().dataType)), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _put(self, df: DataFrame, mode: str) -> None:
        # a bucket is a task, or several if it is large
        names = [*[f.name for f in self.fields], MARK, BATCH]
        df.select(*names, BUCKET).hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(BUCKET, *self.partitions).parquet(self.path)

    def _change(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch: int | None = None) -> list[int]:
        """Rewrite the buckets of `keys`: their rows become change(rows). Gives the buckets' numbers, of which there are
        `buckets` at most."""
        stored = self._rows()
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}
        if batch is not None:
            touched -= {r[0] for r in stored.where(F.col(MARK) & (F.col(BATCH) >= batch)).select(BUCKET).distinct().collect()}
        if not touched:
            return []
        old = stored.where(F.col(BUCKET).isin(sorted(touched)))
        new = change(self._plain(old)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.fields])
        new = new.select("*", F.lit(False).alias(MARK), F.lit(None).cast("long").alias(BATCH), self._bucket()).where(F.col(BUCKET).isin(sorted(touched)))
        last = old.where(MARK).groupBy(BUCKET).agg(F.max(BATCH).alias("last"))
        folders = [BUCKET, *self.partitions]
        # a bucket that had no folder gets one, in the partition of nulls
        first = self.spark.createDataFrame([(b,) for b in sorted(touched)], f"{BUCKET} int").select(BUCKET, *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.fields if f.name in self.partitions])
        marks = old.select(*folders).unionByName(first).distinct().join(F.broadcast(last), BUCKET, "left")  # a row a bucket
        others = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.fields if f.name not in self.partitions]
        marks = marks.select(*folders, *others, F.lit(True).alias(MARK), F.greatest("last", F.lit(batch).cast("long")).alias(BATCH))
        self._put(new.unionByName(marks), "dynamic")
        return sorted(touched)

    def write(self, df: DataFrame) -> None:
        """A new content in place of the old."""
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.fields])
        self._put(rows.select("*", F.lit(False).alias(MARK), F.lit(None).cast("long").alias(BATCH), self._bucket()), "static")

    def upsert(self, new: DataFrame, batch: int | None = None) -> list[int]:
        """Rows in place of those of equal key."""
        return self._change(new, lambda old: upsert(old, new.select(*old.columns), self.key), batch)

    def append(self, new: DataFrame, batch: int | None = None) -> list[int]:
        return self._change(new, lambda old: append(old, new.select(*old.columns)), batch)

    def newest(self, new: DataFrame, order: str, batch: int | None = None) -> list[int]:
        """The last row of each key by `order`, old rows and new together; of equal ones the one whose other columns hash least."""
        tie = F.xxhash64(*[f.name for f in self.fields])
        return self._change(new, lambda old: latest(old.unionByName(new.select(*old.columns)), self.key, [F.desc(order), tie]), batch)

    def delete(self, ids: DataFrame, must_exist: bool = True) -> list[int]:
        """Without the keys of `ids`; KeyError for keys that there aren't."""
        if must_exist:
            delete(self.current(), ids, self.key, must_exist=True)
        return self._change(ids, lambda old: delete(old, ids, self.key))

    def delete_all(self) -> int:
        n = self.current().count()
        self.write(self.spark.createDataFrame([], StructType(self.fields)))
        return n


def delete_from_all(tables: list[VideoTable], ids: DataFrame) -> None:
    """Cascade: the keys go from every table, each rewriting its own buckets."""
    for t in tables:
        t.delete(ids, must_exist=False)
