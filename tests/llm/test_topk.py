import math
import random

import pytest

from twinspark.llm.topk import top_k


def brute(rows, k, every=50):
    ok = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ok = sorted(set(ok))
    out = []
    for qi, q in ok:
        if qi % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(q, x)), i) for i, x in ok if i != qi and len(x) == len(q))[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_equals_brute_force(spark, scale):
    rng = random.Random(int(scale))
    rows = [(i, [rng.gauss(0, scale) for _ in range(20)]) for i in range(1, 900)]
    rows += [(1000 + i, rows[99][1]) for i in range(200)] + [rows[49]] * 3  # a common vector, repeated rows
    rows += [(2000, None), (2050, []), (2100, [1.0] * 19 + [None]), (2150, [1.0] * 19 + [float("nan")]), (None, [1.0] * 20), (2200, [1.0] * 20), (2250, [2.0, 3.0]), (7, [5.0, 1.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, score int").repartition(7)
    got = sorted(tuple(r) for r in top_k(df, query_block=5).collect())
    assert got == brute(rows, 5)
    assert top_k(df.limit(0)).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<double>")
    assert top_k(one).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_repeats_of_the_best_candidates(spark, scale):
    """Repeats of a query's best rows, all in one partition, take one place each; 1e5 takes the path of exact integers."""
    rng = random.Random(8)
    q = [scale * rng.uniform(1, 2) for _ in range(6)]
    rows = [(50, q)] + [(i, [x * (9 - i) for x in q]) for i in range(1, 8)] * 6 + [(100 + i, [x * rng.random() for x in q]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted(tuple(r) for r in top_k(df).collect())
    assert got == brute(rows, 5) and [r[2] for r in got if r[0] == 50] == [1, 2, 3, 4, 5]


def test_hits_are_written_as_blocks_pass(spark, monkeypatch):
    from twinspark.llm import topk

    monkeypatch.setattr(topk, "BLOCKS_WRITTEN", 2)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(1, 600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted(tuple(r) for r in top_k(df, query_block=2).collect()) == brute(rows, 5)
