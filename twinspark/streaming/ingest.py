"""Incremental ingest and search as Structured Streaming."""

from __future__ import annotations

import time as clock
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from twinspark.operators.catalog import VideoTable


def arrivals(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, table: VideoTable, checkpoint: str, order: str = "added_at"):
    """Upsert each micro-batch into `table`, the newest row of a key winning; runs until what is there is taken in.

    A batch rewrites the buckets of its keys alone, and those once: its number stays beside the rows. Files that come out of
    order give the same table.
    """

    def batch(df: DataFrame, number: int) -> None:
        table.newest(df, order, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str = "sha256", time: str = "ts", within: str = "24 hours") -> DataFrame:
    """Rows whose key was not seen within the time to live; state older than that goes."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def progress(stream: DataFrame, time: str = "ts", width: str = "1 day", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    """Counts by tumbling window and kind."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def matched(stream: DataFrame, index: DataFrame, on: str = "h") -> DataFrame:
    """Each arriving item with the items of the static index that have its hash."""
    return stream.join(index, on, "inner")


class _Kept(StatefulProcessor):
    """The newest rows of a key, as a list in the state."""

    def __init__(self, most: int, ttl_ms: int | None, names: tuple[str, str, str]):
        self.most, self.ttl_ms, self.names = most, ttl_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "item string, at long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = set(self.kept.get()) if self.kept.exists() else set()
        new = {(i, int(a)) for f in rows for i, a in zip(f["item"], f["at"])}
        last = sorted(held | new, key=lambda r: (-r[1], r[0]))[: self.most]
        self.kept.put(last)
        k, item, at = self.names
        yield pd.DataFrame({k: [key[0]] * len(last), item: [i for i, _ in last], at: [a for _, a in last], "place": range(1, len(last) + 1)})

    def close(self) -> None:
        pass


def kept_rows(stream: DataFrame, key: str, item: str, time: str, most: int, ttl_ms: int | None = None) -> DataFrame:
    """key, item, time (microseconds) and place (1 is the newest) of what the state of a key holds after each of its batches:
    its `most` newest rows, ties to the smaller item, repeated rows once; older ones are evicted. With `ttl_ms` a row
    leaves the state so long after it came, by the clock. Needs RocksDB as the state store."""
    rows = stream.select(F.col(key).alias("key"), F.col(item).cast("string").alias("item"), F.unix_micros(F.col(time).cast("timestamp")).alias("at")).where("item is not null and at is not null")
    schema = f"{key} {rows.schema['key'].dataType.simpleString()}, {item} string, {time} long, place int"
    mode = "ProcessingTime" if ttl_ms else "None"
    return rows.groupBy("key").transformWithStateInPandas(_Kept(most, ttl_ms, (key, item, time)), schema, "Update", mode)


class ProgressRows(StreamingQueryListener):
    """Writes a row for each micro-batch of a query to a table: rows so far, rows a second since the start, and the seconds that
    are left of `total` rows at that rate (null where the total or the rate isn't known)."""

    SCHEMA = "query string, batch long, rows long, so_far long, seconds double, rate double, seconds_left double"

    def __init__(self, spark: SparkSession, path: str, total: int | None = None):
        self.spark, self.path, self.total = spark, path, total
        self._began: dict[str, float] = {}
        self._rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self._began[str(event.runId)], self._rows[str(event.runId)] = clock.monotonic(), 0

    def onQueryProgress(self, event) -> None:
        p, run = event.progress, str(event.progress.runId)
        self._rows[run] = so_far = self._rows.get(run, 0) + p.numInputRows
        seconds = clock.monotonic() - self._began.setdefault(run, clock.monotonic())
        row = (p.name or str(p.id), p.batchId, p.numInputRows, so_far, seconds, *rate_and_left(so_far, seconds, self.total))
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._began.pop(str(event.runId), None)
        self._rows.pop(str(event.runId), None)


def rate_and_left(so_far: int, seconds: float, total: int | None) -> tuple[float | None, float | None]:
    """Rows a second, and the seconds that the rest of `total` takes at that rate."""
    rate = so_far / seconds if seconds > 0 else None
    return rate, max(0, total - so_far) / rate if total is not None and rate else None


def newest(df: DataFrame, keys: list[str], order: str, most: int, tie: tuple[str, ...] = ()) -> DataFrame:
    """The `most` newest rows of each key; rows of equal time by the columns of `tie`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *tie)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
