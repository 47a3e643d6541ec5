"""What a task holds at once doesn't grow with the queries; results are those of a plain replay."""

import os

import numpy as np
import pytest

from twinspark.operators import cells, similarity


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def ranks(q, x, k):
    """The k best of each query by product, ties to the smaller number."""
    s = q @ x.T
    return {(i, int(j), n + 1) for i in range(len(q)) for n, j in enumerate(np.argsort(-s[i], kind="stable")[:k])}


def test_parts_of_a_matrix():
    assert [p for _, p in similarity.parts(5, 10**9)] == [slice(i, i + 1) for i in range(5)]
    for rows, columns in ((60_000, 10_000), (1, 1), (0, 5), (2_000_000, 0)):
        cuts = [p for _, p in similarity.parts(rows, columns)]
        assert sum(p.stop - p.start for p in cuts) == rows and all((p.stop - p.start) * columns <= similarity.SCORES for p in cuts)


def test_many_queries_with_ties(spark, small_batches):
    """More scores and more hits than a task keeps: queries in three blocks, trimmed in between."""
    rng = np.random.default_rng(3)
    x, q = rng.integers(-3, 4, (4000, 4)).astype(float), rng.integers(-3, 4, (3000, 4)).astype(float)
    frame = lambda m, key: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{key} long, v array<double>").coalesce(1)
    assert len(q) * len(x) > 10 * similarity.SCORES and len(q) * 400 > 2 * similarity.KEPT
    got = similarity.topk(frame(q, "query_id"), frame(x, "video_id"), 400).select("query_id", "rank", "video_id").toPandas().sort_values(["query_id", "rank"])
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :400]
    assert len(got) == want.size and (got.video_id.to_numpy() == want.ravel()).all()


def test_index_passes_queries_by_cells(spark, tmp_path, monkeypatch):
    """Blocks of queries are cut by the number of cells where that is more than the vectors' length."""
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (300, 4)).astype(float)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "video_id long, v array<double>")
    index = cells.VectorIndex(spark, str(tmp_path))
    index.build(d, 40, "dot")
    asked, inner = [], cells.blocks
    monkeypatch.setattr(cells, "blocks", lambda df, key, width: inner(df, key, (asked.append(width), width)[1]))
    got = {(r.query_id, r.video_id, r.rank) for r in index.search(d.withColumnRenamed("video_id", "query_id"), 5, exact=True).collect()}
    assert got == ranks(x, x, 5) and 30 <= asked[0] <= 40


def test_a_pair_of_tiles_is_a_task(spark, monkeypatch):
    """Hashes that meet in tiles are dealt out by pairs of tiles, however few tiles there are."""
    rng = np.random.default_rng(5)
    h = rng.integers(-(1 << 63), 1 << 63, 120)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(h)], "video_id long, h long").repartition(3)
    monkeypatch.setattr(similarity, "TILE_HASHES", 30)
    found = similarity.hamming_pairs(df, df, 26, plan=("tiles", 1))
    d = np.bitwise_count((h[:, None] ^ h[None, :]).view(np.uint64))
    assert {(r.query_id, r.video_id, r.distance) for r in found.collect()} == {(int(i), int(j), int(d[i, j])) for i, j in zip(*np.nonzero(d <= 26))}
    assert found.rdd.getNumPartitions() == 16


def test_dense_rows_have_no_row_a_score(spark, monkeypatch):
    from twinspark.plans.registry import QUERIES

    monkeypatch.setattr(similarity, "scores", lambda *a: pytest.fail("all scores as rows"))
    got = QUERIES["jn15_dense_rows"](spark, "/root/testdata/sf0.001")
    d = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    v = np.stack(d.embedding.to_numpy()).astype(float)
    s = {(int(a), int(b)): x for i, a in enumerate(d.vec_id) if a % 100 == 0 for b, x in zip(d.vec_id, v @ v[i])}
    found = {(r.query_id, r.video_id): r.score for r in got.collect()}
    assert found.keys() == s.keys() and all(abs(found[p] - s[p]) < 1e-6 for p in s)


def test_a_tile_gives_k_rows_an_item(spark, monkeypatch):
    """With k, an item sends its k best of each tile, not of each piece of one."""
    x = np.random.default_rng(6).normal(size=(3000, 200))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "video_id long, v array<double>")
    sent, tiles, ranked, partners = [], [], similarity.ranked, cells.partners
    monkeypatch.setattr(similarity, "ranked", lambda found, k: ranked((sent.append(found.count()), found)[1], k))
    monkeypatch.setattr(cells, "partners", lambda tiled, t: partners((tiles.append(tiled.count()), tiled)[1], t))
    got = similarity.similar_pairs(df, -2.0, "cosine", k=3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, int(j)) for i, row in enumerate(unit @ unit.T) for j in np.argsort(-row)[:3] if i != j}
    assert {(r.query_id, r.video_id) for r in got.collect()} == want and tiles[0] > 1 and sent[0] <= 3 * 3000 * tiles[0]


def test_rounds_of_grouping_broadcast_nothing(spark, monkeypatch):
    """A broadcast passes the driver, and a round would make several."""
    from twinspark.operators import grouping

    plans, inner = [], grouping.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(grouping, "materialize", lambda df, name: inner((plans.append(plan(df)), df)[1], name))
    edges = spark.createDataFrame([(i, (i * 7 + k) % 60, k) for i in range(60) for k in range(1, 4)], "query_id long, video_id long, rank int")
    groups = grouping.greedy_groups(edges, finish=0)
    assert groups.count() and grouping.components(edges).count() == 60
    assert len(plans) > 4 and not any("Broadcast" in p for p in [*plans, plan(groups)])


def test_similarity_maps_are_not_shuffled(spark, monkeypatch):
    from pyspark.sql import functions as F
    from twinspark.operators import catalog
    from twinspark.plans.registry import QUERIES

    monkeypatch.setattr(catalog, "similarity_maps", lambda *a: pytest.fail("a row a pair is grouped"))
    got = QUERIES["snk09_similarity_rows"](spark, "/root/testdata/sf0.01")
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v")).toPandas().set_index("i").v
    found = got.toPandas()
    assert len(found) == len(found[["query_id", "video_id"]].drop_duplicates()) == len(e) * sum(i % 50 == 0 for i in e.index)
    assert all(abs(np.dot(e[q], e[v]) - s) < 1e-6 for q, v, s in found.sample(300, random_state=1).itertuples(index=False))


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_thresholds_are_those_of_sql(spark, metric):
    """Scores a ten-billionth below a threshold stay out, equal ones come; scores are SQL's to the last bit."""
    import duckdb

    rng = np.random.default_rng(7)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x = np.concatenate([unit(rng.normal(size=(40, 16))).astype(np.float32), [[1.0] + [0.0] * 15], [[c] + [0.0] * 14 + [np.sqrt(1 - c * c)] for c in (0.25 - 2e-10, 0.25 + 2e-10, 0.25, 0.25 - 1e-15)], [[0.0] * 16]])
    if metric == "cosine":  # lengths of the last ones aren't exact
        x = np.delete(x, [43, 44], axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "video_id long, v array<double>")
    con = duckdb.connect()
    con.register("t", df.toArrow())
    s = {"dot": "list_dot_product(a.v, b.v)", "cosine": "list_cosine_similarity(a.v, b.v)"}[metric]
    want = {(a, b): c for a, b, c in con.execute(f"SELECT a.video_id, b.video_id, {s} FROM t a JOIN t b ON {s} >= 0.25 AND NOT isnan({s})").fetchall()}
    assert (40, 41) not in want and (40, 42) in want and (metric == "cosine" or (40, 43) in want and (40, 44) not in want)
    found = similarity.topk(df.withColumnRenamed("video_id", "query_id"), df, None, metric, threshold=0.25)
    got = {(r.query_id, r.video_id): r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(got[p] == want[p] or max(p) > 40 and abs(got[p] - want[p]) < 1e-15 for p in want)
    best = similarity.topk(df.withColumnRenamed("video_id", "query_id"), df, 30, metric, threshold=0.25)
    assert {(r.query_id, r.video_id) for r in best.collect()} == want.keys()
    pairs = {p for p in want if p[0] != p[1]}
    assert {(r.query_id, r.video_id) for r in similarity.similar_pairs(df, 0.25, metric).collect()} == pairs
    assert {(r.query_id, r.video_id) for r in similarity.similar_pairs(df, 0.25, metric, k=50).collect()} == pairs


def test_similarity_maps_are_written_as_shown(spark, monkeypatch):
    """Written maps take about half of the 8 bytes a pair that products would; scores come back as SQL's."""
    import glob

    from twinspark.plans import tables as plans
    from twinspark.plans.registry import QUERIES

    paths, inner = [], plans.place
    monkeypatch.setattr(plans, "place", lambda s, name: (paths.append(inner(s, name)), paths[-1])[1])
    got = QUERIES["snk09_similarity_rows"](spark, "/root/testdata/sf0.1").toPandas()
    assert dict(got.dtypes)["score"] == float and (got.score.round(6) == got.score).all() and len(got) == 40 * 2000
    (path,) = [p for p in paths if "similarities" in p]
    written = sum(os.path.getsize(f) for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet"))
    assert written < 6 * len(got)
