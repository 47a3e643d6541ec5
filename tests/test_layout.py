"""Sorted pages, hashes of pictures, streams that keep rows and tell their progress."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspark.operators import linalg, temporal
from twinspark.operators.layout import SortedTable
from twinspark.sources import pictures
from twinspark.streaming import ingest


def rows_read(spark, df):
    """Rows that the scan gave out, what its files' statistics left."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution()
        plan.toRdd().count()
        leaf = plan.executedPlan().collectLeaves().apply(0)
        return leaf.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_pages_and_point_reads_take_a_few_ranges(spark, tmp_path, n):
    t = SortedTable(spark, str(tmp_path))
    t.write(spark.range(n).select((F.col("id") * 3).alias("video_id"), F.lit("x").alias("x")).union(spark.sql("select null, 'n'")).repartition(5), rows=500)
    page = t.page_after(999, 20)
    assert [r.video_id for r in page.collect()] == [1002 + 3 * i for i in range(20)] and rows_read(spark, page) <= 1500
    assert rows_read(spark, t.get(1002)) <= 1000 and t.get(1002).count() == 1
    with pytest.raises(KeyError):
        t.get(1003)
    seen, cursor = [], None
    while len(seen) < 700:  # pages follow each other without gaps
        got = [r.video_id for r in t.page_after(cursor, 100).collect()]
        seen, cursor = seen + got, got[-1]
    assert seen == [3 * i for i in range(700)]
    assert [r.video_id for r in t.page_after(3 * n - 6, 50).collect()] == [3 * n - 3] and t.page_after(3 * n, 50).count() == 0


def test_picture_hash_by_definition():
    rng = np.random.default_rng(3)
    x = np.kron(rng.uniform(0, 255, (16, 20)), np.ones((10, 9)))  # 160 rows of 180
    small = x.copy()
    for _ in range(2):
        for axis in (1, 0):
            window, out = math.ceil(small.shape[axis] / 128), np.zeros_like(small)
            for i in range(small.shape[axis]):
                low, high = max(0, i - (window - 1) // 2), min(small.shape[axis], i + window // 2 + 1)
                out[(slice(None), i) if axis else i] = small[(slice(None), slice(low, high)) if axis else slice(low, high)].mean(axis=axis)
            small = out
    small = np.array([[small[int((i + 0.5) * 160 / 64), int((j + 0.5) * 180 / 64)] for j in range(64)] for i in range(64)])
    low = [sum(small[y, c] * math.cos(math.pi * a * (2 * y + 1) / 128) * math.cos(math.pi * b * (2 * c + 1) / 128) for y in range(64) for c in range(64)) * 2 / 64 for a in range(1, 17) for b in range(1, 17)]
    middle = sorted(low)[127]
    words, good = pictures.picture_hash(x)
    assert [(words[k // 64] >> k % 64) & 1 for k in range(256)] == [int(v > middle) for v in low]
    steps = [abs(int((small[i + di, j + dj] - small[i, j]) * 100 / 255)) for i in range(64) for j in range(64) for di, dj in ((1, 0), (0, 1)) if i + di < 64 and j + dj < 64]
    assert good == min(100, sum(steps) // 90) and good > pictures.MATCH_QUALITY


def test_hashed_pictures_match_their_copies(spark):
    rng = np.random.default_rng(5)
    base = [np.kron(rng.uniform(0, 255, (12, 12)), np.ones((11, 11))) for _ in range(5)]
    near = [np.clip(x + rng.normal(0, 3, x.shape), 0, 255) for x in base]
    rows = [(i, x.ravel().tolist(), 132) for i, x in enumerate(base + near)] + [(20, [7.0] * 400, 20), (21, None, 5), (22, [1.0] * 7, 2), (23, [], 1)]
    got = {r["a.b"]: (r.h, r.quality) for r in pictures.hashed(spark.createDataFrame(rows, "`a.b` int, grey array<double>, width int")).collect()}
    bits = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(got[a][0], got[b][0]))
    assert all(bits(i, 5 + i) <= pictures.MATCH_BITS < bits(i, (i + 1) % 5) for i in range(5))
    assert got[20][1] == 0 and got[21] == got[22] == got[23] == (None, None)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_state_keeps_the_newest_rows(rocks, tmp_path):
    spark, schema = rocks, "event_id long, user_id long, ts timestamp"
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", (F.col("user_id") % 7).alias("user_id"), F.col("ts").cast("timestamp").alias("ts")).orderBy("ts").limit(300)
    e = spark.createDataFrame(e.collect(), schema)

    def run(parts, out):
        """The state after all files that are there; from the checkpoint, if there was a run before."""
        got: dict = {}
        kept = ingest.kept_rows(ingest.arrivals(spark, str(tmp_path / "in"), schema), "user_id", "event_id", "ts", 5)

        def batch(df, _):
            for k, f in df.toPandas().groupby("user_id"):
                got[k] = f.sort_values("place").event_id.astype(int).tolist()

        kept.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", str(tmp_path / out)).trigger(availableNow=True).start().awaitTermination()
        return got

    halves = [e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")]  # out of order
    halves[0].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    first = run(1, "c")
    want = lambda df: {k: f.sort_values(["ts", "event_id"], ascending=[False, True]).event_id.tolist() for k, f in ingest.newest(df, ["user_id"], "ts", 5, ("event_id",)).toPandas().groupby("user_id")}
    assert first == want(halves[0])
    halves[1].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert {**first, **run(1, "c")} == want(e)  # restarted: the rows of the first run are still there


def test_progress_rows(spark, tmp_path):
    spark.range(90).repartition(3).write.parquet(str(tmp_path / "in"))
    listener = ingest.ProgressRows(spark, str(tmp_path / "progress"), total=120)
    spark.streams.addListener(listener)
    try:
        q = ingest.arrivals(spark, str(tmp_path / "in"), "id long").writeStream.format("noop").queryName("q").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows: list = []
        for _ in range(60):  # listeners are told a little later
            time.sleep(0.5)
            if (tmp_path / "progress").exists():
                rows = spark.read.schema(ingest.ProgressRows.SCHEMA).parquet(str(tmp_path / "progress")).orderBy("batch").collect()
            if len(rows) >= 3:
                break
    finally:
        spark.streams.removeListener(listener)
    assert sum(r.rows for r in rows) == 90 and rows[-1].so_far == 90
    for r in rows:
        assert r.rate == pytest.approx(r.so_far / r.seconds) and r.seconds_left == pytest.approx((120 - r.so_far) / r.rate)
    assert ingest.rate_and_left(0, 0.0, 5) == (None, None) and ingest.rate_and_left(10, 2.0, 5) == (5.0, 0.0)


def test_matrices_saved_and_used(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(99, None)], "`a.b` int, v array<double>").repartition(3)
    mean, w = linalg.pca_fit(df.where("v is not null"), 3)
    linalg.save_matrices(spark, str(tmp_path), {"mean": [mean], "pca": w})
    model = linalg.load_matrices(spark, str(tmp_path))
    got = {r["a.b"]: r.projected for r in linalg.projected(df, model["pca"], model["mean"]).collect()}
    want = (x - np.array(mean)) @ np.array(w).T
    assert got[99] is None and np.allclose([got[i] for i in range(40)], want)
    y = want
    assert np.allclose(y.T @ y, np.eye(3), atol=1e-6)


def test_steps_from_a_configuration(spark):
    frames = spark.createDataFrame([(v, i, v * 100 + i) for v in range(30) for i in range(8)], "video_id int, frame_idx int, f int")
    order = lambda df, v: [r.f for r in df.where(F.col("video_id") == v).orderBy("frame_idx").collect()]
    made = temporal.from_config([{"kind": "crop", "start": 2, "size": 6}, {"kind": "fast_forward", "k": 2}, {"kind": "reverse"}])
    assert order(made(frames), 3) == [306, 304, 302]
    choice = temporal.from_config([{"kind": "choice", "seed": 1, "of": [{"weight": 2, "steps": [{"kind": "reverse"}]}, {"steps": []}]}])(frames)
    firsts = {v: order(choice, v)[0] - v * 100 for v in range(30)}
    assert set(firsts.values()) == {0, 7} and choice.count() == frames.count()
    with pytest.raises(ValueError, match="unknown step"):
        temporal.from_config([{"kind": "blur"}])
    with pytest.raises(TypeError):
        temporal.from_config([{"kind": "fast_forward", "speed": 2}])
