"""Vector indexes, pruned tiles and greedy groups against plain replays."""

import random

import numpy as np
import pytest

from twinspark.operators import cells, grouping, similarity


def vectors(n=1500, dim=16, groups=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, key="video_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} long, v array<double>").repartition(5)


def test_index_recall_and_exact_answer(spark, tmp_path):
    x = vectors()
    q = x[::15] + 0.05 * np.random.default_rng(1).normal(size=x[::15].shape)
    df, queries = frame(spark, x), frame(spark, q, "query_id")
    index = cells.VectorIndex(spark, str(tmp_path))
    index.build(df.unionByName(spark.createDataFrame([(9999, None)], df.schema)), 32)
    want = {(r.query_id, r.rank): r.video_id for r in similarity.topk(queries, df, 10, "cosine").collect()}
    exact = {(r.query_id, r.rank): r.video_id for r in index.search(queries, 10, probes=2, exact=True).collect()}
    assert exact == want
    near = {(r.query_id, r.video_id) for r in index.search(queries, 10, probes=4).collect()}
    assert len(near & {(a, v) for (a, _), v in want.items()}) >= 0.9 * len(want)
    one = index.search(queries.where("query_id = 0"), 10, probes=3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    part = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "cell" in part and part.count(",") <= 3 and one.count() == 10


def test_index_without_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "video_id string, v array<double>")
    index = cells.VectorIndex(spark, str(tmp_path))
    index.build(df, 4)
    q = spark.createDataFrame([("a", [1.0])], "query_id string, v array<double>")
    assert index.search(q, 3).count() == 0 and index.search(q, 3, exact=True).count() == 0
    index.build(spark.createDataFrame([("x", [1.0]), ("y", [0.5])], df.schema), 4, "dot")
    assert [tuple(r) for r in index.search(q, 3, probes=1, exact=True).orderBy("rank").collect()] == [("a", "x", 1.0, 1), ("a", "y", 0.5, 2)]


@pytest.mark.parametrize("metric,threshold", [("dot", 0.9), ("cosine", 0.95)])
def test_pruned_tiles_lose_no_pair(spark, monkeypatch, metric, threshold):
    monkeypatch.setattr(similarity, "TILE_VALUES", 16 * 20)
    x = vectors(900) * (1 if metric == "cosine" else np.random.default_rng(5).uniform(0.9, 1.1, (900, 1)))
    x[600:] = x[0]  # a third of the rows are equal: one cell, several tiles
    df = frame(spark, x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    s = np.rint(unit @ unit.T * 1e9) >= np.rint(threshold * 1e9)
    np.fill_diagonal(s, False)
    got = [(r.query_id, r.video_id) for r in similarity.similar_pairs(df, threshold, metric).collect()]
    assert len(got) == len(set(got)) and set(got) == set(zip(*map(lambda a: a.tolist(), np.nonzero(s))))
    tiled = cells.tiles(df, 20, metric)
    n, met = tiled.count(), cells.partners(tiled, threshold).count()
    assert met < 0.6 * n * (n + 1) / 2


def replay(edges):
    partners = {}
    for q, m, rank in sorted(edges, key=lambda e: (e[0], e[2], e[1])):
        if q != m and m not in partners.setdefault(q, []):
            partners[q].append(m)
    seen, out = set(), {}
    for q in sorted(partners):
        members = [q, *partners[q]]
        if partners[q] and q not in seen and sum(m not in seen for m in members) > 1:
            out[q] = members
            seen.update(members)
    return out


def graphs():
    rng = random.Random(4)
    for n, k in ((40, 2), (60, 5), (30, 12)):
        yield [(q, m, r) for q in range(n) for r, m in enumerate(rng.sample(range(n), rng.randrange(k + 1)))]
    yield [(i, j, r) for i in range(18) for r, j in enumerate((i - 1, i + 1)) if 0 <= j < 18]  # a chain along the ids
    yield [(q, m, m) for q in range(25) for m in range(25)]  # everything is one component
    yield [(q, 0, 1) for q in range(1, 40)] + [(q, 50 + q, 2) for q in range(1, 40)]  # a member of all lists


@pytest.mark.parametrize("finish", [0, 30, 100_000])
def test_greedy_groups_equal_the_replay(spark, finish):
    for edges in list(graphs()) if finish < 100 else [*graphs(), []]:
        df = spark.createDataFrame([*edges, (None, 1, 1), (1, None, 1)], "query_id long, video_id long, rank int").dropna()
        got = {}
        for r in grouping.greedy_groups(df, finish=finish).orderBy("group_id", "place").collect():
            got.setdefault(r.group_id, []).append(r.video_id)
        assert got == replay(edges)
