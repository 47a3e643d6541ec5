import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspark.functions import scalar as S
from twinspark.operators import catalog, chamfer, grouping, linalg, metrics, models, pooling, similarity, temporal
from twinspark.operators.engine import Config, Engine
from twinspark.sources import files
from twinspark.streaming import ingest


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize("seconds,name", [(None, "unknown"), (0.0, "unknown"), (-1.0, "unknown"), (10.0, "0-10s"), (10.01, "10-30s"), (30.0, "10-30s"), (60.0, "30-60s"), (300.0, "1-5m"), (1800.0, "5-30m"), (1800.1, "30m+")])
def test_duration_bucket(spark, seconds, name):
    assert one(spark, b=S.duration_bucket(F.lit(seconds).cast("double"))).b == name


@pytest.mark.parametrize("w,h,name", [(16, 9, "landscape"), (9, 16, "portrait"), (1, 1, "square"), (6, 5, "square"), (4, 5, "square"), (0, 5, "unknown"), (5, 0, "unknown"), (None, 5, "unknown")])
def test_aspect(spark, w, h, name):
    assert one(spark, a=S.aspect_class(F.lit(w).cast("int"), F.lit(h).cast("int"))).a == name


def test_hash_formats(spark):
    r = one(spark, a=S.hash_text(F.lit(15).cast("long")), b=S.hash_text(S.hash_number(F.lit("a1b2c3d4e5f60718"))), c=S.hash_number(F.lit("zz")), d=S.hash_number(F.lit("")), e=S.hash_number(F.lit("1" * 17)))
    assert tuple(r) == ("f", "a1b2c3d4e5f60718", None, None, None)


@pytest.mark.parametrize("d,score", [(0, 1.0), (3, 0.953), (5, 0.922), (10, 0.844), (64, 0.0)])
def test_hamming_score(spark, d, score):
    x = (1 << d) - 1
    x = x - (1 << 64) if x >> 63 else x
    assert round(one(spark, s=S.hamming_score(F.lit(0).cast("long"), F.lit(x).cast("long"))).s, 3) == score


def test_text_functions(spark):
    r = one(spark, a=S.fraction(F.lit("30000/1001")), b=S.fraction(F.lit("0/0")), c=S.fraction(F.lit("x")), d=S.without_token(F.lit("a_b")), e=S.without_token(F.lit("a")), f=S.stem(F.lit("/x/y.z.mp4")), g=S.suffix(F.lit("/x/y.MP4")), h=S.clock(F.lit(3725.0)), i=S.clock(F.lit(65.0)), j=S.stem(F.lit("/x/.hidden")))
    assert tuple(r) == (29.97, 0.0, 0.0, "a", "a", "y.z", "mp4", "1:02:05", "1:05", ".hidden")


def test_chamfer_and_masks(spark):
    cells = spark.createDataFrame([(1, 2, 0, 0, 1.0), (1, 2, 0, 1, 0.0), (1, 2, 1, 0, 0.0), (1, 2, 1, 1, 0.5)], "query_id int, video_id int, i int, j int, s double")
    assert chamfer.chamfer(cells).first().score == 0.75
    assert chamfer.chamfer(cells.where("j <> 0")).first().score == 0.25


def test_padding_matches_doubling(spark):
    rows = [(n, m) for n in range(1, 9) for m in range(1, 9)]
    for exceed in (False, True):
        for m in range(1, 9):
            got = {r.n: r.c for r in spark.createDataFrame([(n,) for n in range(1, 9)], "n int").select("n", temporal.copies(F.col("n"), m, exceed).alias("c")).collect()}
            for n, mm in rows:
                if mm == m:
                    size = n
                    while size < m or exceed and size <= m:
                        size *= 2
                    assert got[n] * n == size


def test_subsample_matches_linspace(spark):
    for n in (61, 100, 777):
        f = spark.range(n).select(F.lit(1).alias("video_id"), F.col("id").alias("frame_idx"), F.col("id").alias("f"))
        got = [r.f for r in temporal.subsampled(f, 60).orderBy("frame_idx").collect()]
        assert got == np.linspace(0, n - 1, 60, dtype=int).tolist()
    assert [r.f for r in temporal.subsampled(spark.range(5).select(F.lit(1).alias("video_id"), F.col("id").alias("frame_idx"), F.col("id").alias("f")), 1).collect()] == [0]


def test_average_precisions(spark):
    scored = spark.createDataFrame([(1, v, 1.0 - v / 10) for v in range(3)], "query_id int, video_id int, score double")
    truth = spark.createDataFrame([(1, 0), (1, 2)], "query_id int, video_id int")
    assert math.isclose(metrics.average_precision(scored, truth).first().ap, (1 + 2 / 3) / 2)
    assert math.isclose(metrics.trapezoid_average_precision(scored, truth).first().ap, ((1 + 1) + (2 / 3 + 1 / 2)) / 4)
    nothing = truth.where("query_id = 9")
    assert metrics.average_precision(scored, nothing).count() == 0 and metrics.average_precision(scored, nothing, "zero").first().ap == 0
    assert math.isclose(metrics.pooled_average_precision(scored, truth).first().uap, (1 + 2 / 3) / 2)


@pytest.mark.parametrize("distance,bits,plan", [(0, 64, ("equal", 1)), (5, 64, ("equal", 6)), (5, 64, ("near", 3)), (11, 64, ("near", 6)), (20, 64, ("tiles", 1)), (20, 64, ("near", 11)), (31, 256, ("near", 16)), (31, 256, ("tiles", 1)), (3, 256, ("equal", 4)), (9, 64, None)])
def test_hamming_pairs_equal_nested_loop(spark, distance, bits, plan):
    rng = random.Random(distance)
    base = [rng.getrandbits(bits) for _ in range(12)]
    # copies up to a few bits farther than what is asked for, and a third of all hashes equal
    h = [b ^ sum(1 << k for k in rng.sample(range(bits), rng.randrange(distance + 4))) for b in base for _ in range(8)] + [base[0]] * 48
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, [signed(x >> 64 * w & (1 << 64) - 1) for w in range(bits // 64)]) for i, x in enumerate(h)] + [(999, None)]
    df = spark.createDataFrame(rows, "video_id int, h array<long>")
    df = df if bits > 64 else df.withColumn("h", F.get("h", F.lit(0)))
    got = [((r.query_id, r.video_id), (r.distance, r.score)) for r in similarity.hamming_pairs(df, df, distance, bits, plan).collect()]
    want = {(i, j): (n, 1 - n / bits) for i, a in enumerate(h) for j, b in enumerate(h) if (n := (a ^ b).bit_count()) <= distance}
    assert dict(got) == want and len(got) == len(want)


def test_bands_find_few_candidates():
    """Candidates of random hashes as a share of all pairs: what the plan says, counted."""
    assert [similarity.hamming_plan(d, 64, 10**6)[0] for d in (0, 3, 5, 8, 20)] == ["equal", "equal", "near", "near", "tiles"]
    assert similarity.hamming_plan(5, 64, 100)[0] == "tiles" and similarity.hamming_plan(31, 256, 10**6) == ("near", 16)
    rng = np.random.default_rng(0)
    for distance, bits, most in ((5, 64, 0.01), (8, 64, 0.02), (31, 256, 0.01)):
        kind, bands = similarity.hamming_plan(distance, bits, 10**7)
        x = rng.integers(0, 2, (400, bits), dtype=np.int8)
        found = np.zeros((400, 400), bool)
        for lo, hi in similarity._cuts(bands, bits):
            found |= (x[:, None, lo:hi] != x[None, :, lo:hi]).sum(axis=2) <= (kind == "near")
        assert (found.sum() - 400) / (400 * 399) < most


def test_topk_ties_and_blocks(spark, monkeypatch):
    v = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [0.5, 0.5]]
    index = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "video_id int, v array<double>").repartition(3)
    queries = index.withColumnRenamed("video_id", "query_id")
    want = [(0, 0, 1), (0, 2, 2), (1, 1, 1), (1, 4, 2), (2, 0, 1), (2, 2, 2), (3, 0, 1), (3, 2, 2), (4, 0, 1), (4, 1, 2)]
    for values in (8_000_000, 4):
        monkeypatch.setattr(similarity, "BROADCAST_VALUES", values)
        assert sorted((r.query_id, r.video_id, r.rank) for r in similarity.topk(queries, index, 2).collect()) == want
    assert similarity.topk(queries.limit(0), index, 2).count() == 0
    assert similarity.topk(queries, index.limit(0), 2).count() == 0


def test_greedy_and_components_differ(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (2, 3, 2), (3, 2, 1), (4, 5, 1), (5, 4, 1), (5, 6, 2), (6, 5, 1), (6, 7, 2), (7, 6, 1)], "query_id int, video_id int, rank int")
    groups = {}
    for r in grouping.greedy_groups(edges).orderBy("place").collect():
        groups.setdefault(r.group_id, []).append(r.video_id)
    # 3 starts a group only with an unseen partner, so it has none; 6 takes the seen 5 along
    assert groups == {1: [1, 2], 4: [4, 5], 6: [6, 5, 7]}
    assert {r.video_id: r.component for r in grouping.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "query_id int, video_id int")
    assert {r.component for r in grouping.components(chain).collect()} == {0}


def test_regions(spark):
    assert pooling.grid_regions(7, 7)[0] == (1, 0, 0, 7, 7) and len(pooling.grid_regions(7, 7)) == 14
    assert all(t >= 0 and left >= 0 and t + h <= 6 and left + w <= 9 for _, t, left, h, w in pooling.grid_regions(6, 9))
    # by hand: 6 rows, 9 columns; two squares of 6 overlap by a half, which is nearest to 0.4, so the longer side has one more
    levels = {1: (6, [0], 9, [0]), 2: (4, [0, 2], 4, [0, 2, 5]), 3: (3, [0, 1, 3], 3, [0, 2, 4, 6])}
    want = [(n, top, left, h, w) for n, (h, tops, w, lefts) in levels.items() for top in tops for left in lefts]
    assert pooling.grid_regions(6, 9) == want
    assert sorted((n, left, top, w, h) for n, top, left, h, w in pooling.grid_regions(9, 6)) == sorted(want)
    assert pooling.grid_regions(1, 1) == [(1, 0, 0, 1, 1)]


def test_perceptual_hash_by_definition(spark):
    from twinspark.sources.files import hashed_pictures

    rng = np.random.default_rng(3)
    pictures = [rng.normal(size=1024).tolist() for _ in range(3)] + [[0.0] * 1024, [1.0] * 5, None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pictures)], "id int, p array<double>")
    # two projections that Spark merges
    got = {r.id: r.h for r in hashed_pictures(df.select("id", F.transform("p", lambda x: x * 2).alias("grey"))).select("id", "h").collect()}
    for i, p in enumerate(pictures[:3]):
        low = [[sum(2 * p[32 * y + x] * math.cos(math.pi * (2 * y + 1) * a / 64) * math.cos(math.pi * (2 * x + 1) * b / 64) for y in range(32) for x in range(32)) for b in range(8)] for a in range(8)]
        flat = [v for row in low for v in row]
        assert got[i] & (1 << 64) - 1 == int("".join("1" if v > float(np.median(flat)) else "0" for v in flat), 2)
    assert got[3] == 0 and got[4] is got[5] is None


def test_linear_algebra(spark):
    x = np.random.default_rng(0).normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(3)
    mean, w = linalg.pca_fit(df, 3)
    y = (x - np.array(mean)) @ np.array(w).T
    assert np.allclose(y.T @ y, np.eye(3), atol=1e-6)


@pytest.mark.parametrize("rounds", [0, 3, 50])
def test_rotation_by_definition(spark, rounds):
    """In plain numpy: eigenvectors of the covariance, neither centred nor whitened use, rotations from the signs."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) + 0.7
    values, vectors = np.linalg.eigh(np.cov(x.T))
    top = vectors[:, np.argsort(-values)[:4]]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(4)])
    v = x @ top
    r = np.linalg.svd(np.random.default_rng(7).normal(size=(4, 4)))[0]
    for _ in range(rounds):
        signs = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(signs.T @ v)
        r = vt @ u.T
    df = spark.createDataFrame([(row.tolist(),) for row in x] + [(None,)], "v array<double>").repartition(3)
    got = np.array(linalg.itq_fit(df, 4, rounds=rounds, seed=7)).T
    assert np.allclose(got, top @ r, atol=1e-6)
    assert ((x @ got >= 0) == (x @ (top @ r) >= 0)).all()
    assert linalg.itq_fit(df.where("v is null"), 4, rounds=rounds) == []


def test_vlad_by_definition(spark):
    """In plain numpy, with a mask, other weights than the centroids, a linear layer and the layer norm."""
    rng = np.random.default_rng(6)
    c, w, linear = rng.normal(size=(3, 5)), rng.normal(size=(3, 5)), rng.normal(size=(4, 15))
    x = {v: rng.normal(size=(n, 5)) for v, n in (("a", 7), ("b", 1), (None, 3))}
    rows = [(v, f.tolist(), i != 2) for v, m in x.items() for i, f in enumerate(m)] + [("gone", [1.0] * 5, False), ("a", None, True)]
    df = spark.createDataFrame(rows, "video_id string, f array<double>, seen boolean").repartition(4)
    got = {r.video_id: r.f for r in linalg.vlad(df, c, "seen", linear, weights=w).collect()}
    assert set(got) == set(x)
    for v, m in x.items():
        m = np.delete(m, 2, axis=0) if len(m) > 2 else m
        total = np.zeros((3, 5))
        for f in m:
            a = np.exp(w @ f) / np.exp(w @ f).sum()
            total += a[:, None] * (f - c)
        total /= np.linalg.norm(total, axis=1, keepdims=True)
        out = linear @ (total.ravel() / np.linalg.norm(total))
        assert np.allclose(got[v], (out - out.mean()) / np.sqrt(out.var() + 1e-5))


def test_comparator():
    rng = np.random.default_rng(0)
    shapes = [(4, 1, 3, 3), (4, 4, 3, 3), (4, 4, 3, 3), (1, 4, 1, 1)]
    weights = [(rng.normal(size=s) / 3, np.zeros(s[0])) for s in shapes]
    m = rng.normal(size=(9, 8))
    assert models.compare_matrix(m, weights).shape == (2, 2) and models.compare_matrix(m[:3], weights) is None
    by_hand = sum(np.pad(m, 1)[k : k + 9, n : n + 8] * weights[0][0][0, 0, k, n] for k in range(3) for n in range(3))
    assert np.allclose(models._convolved(m[None], *weights[0])[0], by_hand)
    refined = models.refined(weights)
    assert refined(m[:3]) is None and refined(m) == pytest.approx((np.clip(models.compare_matrix(m, weights), -1, 1) / 2 + 0.5).max(axis=1).mean())


def test_embedders(spark):
    class Mean:
        dim = 1

        def __call__(self, pixels):
            return [[float(np.mean(p))] for p in pixels]

    models.register_embedder("mean", Mean)
    frames = spark.createDataFrame([("a", 0, [1.0, 3.0]), ("a", 1, [5.0])], "video_id string, frame_idx long, pixels array<double>")
    assert sorted(r.f[0] for r in models.embedded(frames, "mean", batch=1).collect()) == [2.0, 5.0]
    with pytest.raises(ValueError):
        models.embedder("other")
    with pytest.raises(ValueError):
        models.check_heads(True, True)


def test_perceptual_hash(spark):
    rng = np.random.default_rng(3)
    a = rng.random(1024)
    h = files.perceptual_hash(a)
    near = files.perceptual_hash(a * 0.9 + 0.02)
    assert ((h ^ near) & (1 << 64) - 1).bit_count() == 0 and 28 <= (h & (1 << 64) - 1).bit_count() <= 36
    df = spark.createDataFrame([(a.tolist(),), ([1.0],), (None,)], "grey array<double>")
    assert [r.h for r in files.hashed_pictures(df).collect()] == [h, None, None]


def test_files(spark, tmp_path):
    for name, data in (("a.mp4", b"xx"), (".b.mp4", b"x"), ("c.txt", b"x"), ("d.MKV", b""), ("s/00012.jpg", b"1"), ("s/x.jpg", b"1")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.listed(spark, str(tmp_path)).withColumn("real_path", F.col("path"))
    assert [r.video_id for r in files.distinct_media(found).collect()] == ["a"]
    assert [(r.video_id, r.frame_idx) for r in files.frame_files(spark, str(tmp_path)).collect()] == [("s", 12)]
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))

    def decode(c):
        if c == b"xx":
            return [b"f0", b"f1"]
        raise ValueError

    assert files.decoded(content, decode).count() == 2


def test_catalog(spark):
    base = spark.createDataFrame([(i, "a") for i in range(45)], "video_id int, x string")
    pages, cursor = [], None
    while True:
        page, cursor = catalog.page_at(base, cursor, 20)
        pages.append((page.count(), cursor))
        if cursor is None:
            break
    assert pages == [(20, "20"), (20, "40"), (5, None)]
    assert catalog.page_at(base, "bad", 20)[1] == "20" and catalog.page_after(base, 40, 500).count() == 4
    with pytest.raises(KeyError):
        catalog.delete(base, spark.createDataFrame([(99,)], "video_id int"), must_exist=True)
    with pytest.raises(KeyError):
        catalog.get(base, 99)


def test_engine(spark, tmp_path):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(30, 8))
    vecs[1], vecs[2] = vecs[0] * 2, vecs[0] + 0.01
    rows = [(f"v{i:02d}", f"/v/{i}.mp4", 1920, 1080, 20.0, "ff00ff00ff00ff00" if i < 2 else f"{i:x}", v.tolist()) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "video_id string, path string, width int, height int, duration double, phash string, v array<double>")
    e = Engine(spark, str(tmp_path), Config.load('{"threshold": 0.9, "unknown": 1}'))
    assert e.config.threshold == 0.9 and Config.load(e.config.saved()) == e.config
    e.add(df)
    e.add(df.limit(3))
    assert e.status().first().videos == 30
    q = df.where("video_id = 'v00'")
    plan = e._pruned(e.videos.current(), q.withColumn("duration_bucket", F.lit("10-30s")).withColumn("aspect_ratio", F.lit("landscape")))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(duration_bucket" in plan and "aspect_ratio" in plan.split("PartitionFilters")[1][:300]
    got = e.search(q, rerank=False).orderBy("rank").collect()
    assert [r.video_id for r in got] == ["v00", "v01", "v02"] and got[0].path == "/v/0.mp4" and got[0].score == 1.0
    assert {r.video_id for r in e.duplicates().collect()} == {"v00", "v01", "v02"}
    assert e.resume(df.limit(5)).count() == 0
    e.delete(q.select("video_id"))
    assert e.status().first().videos == 29 and e.page(None, 20)[1] == "20"
    with pytest.raises(KeyError):
        e.delete(q.select("video_id"))
    assert e.delete_all() == 29 and e.status().first().videos == 0


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    stream = ingest.arrivals(spark, str(tmp_path / "in"), schema)
    q = ingest.progress(stream).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from progress").first()[0] == e.count()
    table = catalog.VideoTable(spark, str(tmp_path / "t"), "video_id string, value double, added_at timestamp", (), buckets=4)
    ingest.ingest(stream.select(F.col("user_id").cast("string").alias("video_id"), "value", F.col("ts").alias("added_at")), table, str(tmp_path / "c")).awaitTermination()
    want = {str(r.user_id): r.value for r in catalog.latest(e, "user_id", [F.desc("ts")]).collect()}
    assert {r.video_id: r.value for r in table.current().collect()} == want


def test_first_seen_within_a_day(spark, tmp_path):
    """A key's state goes once the watermark, a day behind the latest row, passes a day after the row that was let through."""
    batches = [[("a", 0), ("b", 1)], [("a", 10), ("c", 30)], [("a", 40), ("d", 60)], [("a", 70), ("d", 71)]]
    for rows in batches:
        df = spark.createDataFrame(rows, "sha256 string, hour long").select("sha256", F.timestamp_seconds((F.col("hour") + 1000) * 3600).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.arrivals(spark, str(tmp_path / "in"), "sha256 string, ts timestamp")
        q = ingest.first_seen(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.sha256, r.ts.timestamp() // 3600 - 1000) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0), ("a", 70), ("b", 1), ("c", 30), ("d", 60)]
