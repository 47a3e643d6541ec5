"""Changes that rewrite only the buckets they touch, and the engine that uses them."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspark.operators.cascade import SearchOptions
from twinspark.operators.catalog import VideoTable
from twinspark.operators.engine import Config, Engine
from twinspark.streaming import ingest

DDL = "video_id bigint, x string, kind string"


def data(path):
    return {str(p.relative_to(path)): p.stat().st_size for p in Path(path).rglob("*.parquet")}


def state(t):
    return sorted(map(tuple, t.current().collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    t = VideoTable(spark, str(tmp_path / "t"), DDL, ("kind",), buckets=256)
    t.write(spark.range(4000).select(F.col("id").alias("video_id"), F.lit("a").alias("x"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind")))
    return t


def test_a_change_writes_its_bucket_alone(spark, table):
    before, rows = data(table.path), state(table)
    new = spark.createDataFrame([("new", 7, "k9")], "x string, video_id int, kind string")
    (touched,) = table.upsert(new)
    after = data(table.path)
    inside = lambda files: {f: n for f, n in files.items() if f.startswith(f"__bucket={touched}/")}
    assert {f: n for f, n in before.items() if f not in inside(before)} == {f: n for f, n in after.items() if f not in inside(after)}
    assert sum(inside(after).values()) < 0.05 * sum(after.values())
    assert state(table) == sorted([r for r in rows if r[0] != 7] + [(7, "new", "k9")], key=str)


def test_folders_that_become_empty(spark, table):
    """The row leaves its folder for another one, and a bucket loses all of its rows."""
    rows = state(table)
    bucket = table.current().select("video_id", table._bucket()).where("video_id = 7").first()[1]
    ids = [r.video_id for r in table.current().select("video_id", table._bucket()).where(F.col("__bucket") == bucket).collect()]
    table.delete(spark.createDataFrame([(i,) for i in ids], "video_id bigint"))
    assert state(table) == [r for r in rows if r[0] not in ids]
    table.append(spark.createDataFrame([(7, "b", None)], DDL))
    assert state(table) == sorted([r for r in rows if r[0] not in ids] + [(7, "b", None)], key=str)
    with pytest.raises(KeyError):
        table.delete(spark.createDataFrame([(7,), (99999,)], "video_id bigint"))
    assert table.of_keys([7, 5, 99999]).count() == 2
    assert table.delete_all() == len(rows) - len(ids) + 1 and table.current().count() == 0
    table.upsert(spark.createDataFrame([(1, "c", "k"), (None, "n", "k")], DDL))
    assert state(table) == [(1, "c", "k"), (None, "n", "k")]


def test_a_batch_counts_once(spark, tmp_path):
    t = VideoTable(spark, str(tmp_path / "t"), DDL, (), buckets=8)
    first = spark.range(50).select(F.col("id").alias("video_id"), F.lit("a").alias("x"), F.lit("k").alias("kind"))
    assert len(t.append(first, 0)) == 8 and t.append(first, 0) == []
    # a batch that was written in part: one bucket has it, the others get it when it is run again
    more = first.withColumn("x", F.lit("b"))
    own = more.where(t._bucket() == 3)
    assert t.append(own, 1) == [3] and sorted(t.append(more, 1)) == [0, 1, 2, 4, 5, 6, 7]
    assert t.current().groupBy("video_id").count().where("count <> 2").count() == 0 and t.current().count() == 100
    t.delete(first.limit(3))  # a change without a number leaves the numbers
    assert t.append(more, 1) == [] and t.current().count() == 94


def test_stream_run_again_from_the_start(spark, tmp_path):
    rows = [(i % 20, float(i), i // 4) for i in range(100)]
    df = spark.createDataFrame(rows, "video_id long, value double, t long").withColumn("added_at", F.timestamp_seconds("t"))
    df.select("video_id", "value", "added_at").repartitionByRange(3, "value").write.parquet(str(tmp_path / "in"))
    t = VideoTable(spark, str(tmp_path / "t"), "video_id long, value double, added_at timestamp", (), buckets=4)
    ingest.ingest(ingest.arrivals(spark, str(tmp_path / "in"), "video_id long, value double, added_at timestamp"), t, str(tmp_path / "c")).awaitTermination()
    want, before = {i: max(r[1] for r in rows if r[0] == i and r[2] == max(x[2] for x in rows if x[0] == i)) for i in range(20)}, data(t.path)
    assert {r.video_id: r.value for r in t.current().collect()} == want
    # another checkpoint gives the same batches the same numbers: nothing is written
    ingest.ingest(ingest.arrivals(spark, str(tmp_path / "in"), "video_id long, value double, added_at timestamp"), t, str(tmp_path / "c2")).awaitTermination()
    assert data(t.path) == before


def test_engine_compares_all_regions(spark, tmp_path):
    """Both candidates have the query's region 0; region 1 alone tells them apart."""
    rng = np.random.default_rng(1)
    unit = lambda: (x := rng.normal(size=8)) / np.linalg.norm(x)
    base = [unit() for _ in range(4)]
    other = {"q": [unit() for _ in range(4)], "far": [unit() for _ in range(4)]}
    other["near"] = other["q"]
    rows = [(v, i, r, f.tolist()) for v in ("q", "near", "far") for i in range(4) for r, f in enumerate((base[i], other[v][i]))]
    frames = spark.createDataFrame(rows, "video_id string, frame_idx int, region_idx int, f array<double>")
    v = rng.normal(size=4)
    videos = spark.createDataFrame([(n, (v + (0 if n == "q" else 0.9 * np.roll(v, 1))).tolist(), 5.0) for n in ("q", "near", "far")], "video_id string, v array<double>, duration double")
    e = Engine(spark, str(tmp_path), Config(threshold=0.3))
    e.add(videos, frames)
    assert e.frames.current().count() == 24
    got = {r.video_id: r.score for r in e.search(videos.where("video_id = 'q'"), SearchOptions(threshold=0.3, skip_from=0.999)).collect()}
    region = lambda a, b: np.mean([max(np.clip(x @ y, -1, 1) for y in b) for x in a])
    f = {n: [[base[i], other[n][i]] for i in range(4)] for n in other}
    want = {n: np.mean([max(region(a, b) / 2 + 0.5 for b in f[n]) for a in f["q"]]) for n in ("near", "far")}
    assert got["near"] == pytest.approx(want["near"], abs=1e-4) and got["far"] == pytest.approx(want["far"], abs=1e-4) and got["near"] > got["far"] + 0.1
    e.add(videos.where("video_id = 'far'"), frames.where("video_id = 'far' and region_idx = 0"))
    assert e.frames.current().where("video_id = 'far'").count() == 4
