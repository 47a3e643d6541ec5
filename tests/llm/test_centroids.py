import hashlib
import math
import random

import numpy as np
import pytest

from twinspark.llm.centroids import Screen, clusters


def brute(rows, k, rounds, width):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centroids = [x for _, x in sorted((sha(i), x) for i, x in kept if i is not None)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        groups = [[x for (_, x), o in zip(kept, own) if o == j] for j in range(len(centroids))]
        centroids = [[sum(c) // len(g) for c in zip(*g)] if g else centroids[j] for j, g in enumerate(groups)]
    return sorted(((i is None, i or 0, near(x)[1], near(x)[0]) for i, x in kept), key=str), centroids


@pytest.mark.parametrize("width,scale", [(6, 1.0), (7, 0.01), (8, 1e5)])
def test_equals_brute_force(spark, width, scale):
    """0.01 gives many ties and equal vectors; 1e5 components of 27 bits."""
    rng = random.Random(width)
    rows = [(i, [rng.gauss(0, scale) for _ in range(width)]) for i in range(300)] + [(1000 + i, [0.0] * width) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * (width - 1) + [None]), (2003, [1.0] * (width - 1) + [float("nan")]), (2004, [1.0] * (width - 1) + [float("-inf")]), (2005, [1.0] * (width + 1))]
    rows += [(None, [0.5 * scale] * width), rows[3], rows[3]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, `a.b` string").repartition(5)
    found, centroids = clusters(df, k=9, rounds=3, width=width)
    want, want_c = brute(rows, 9, 3, width)
    assert sorted(((r[0] is None, r[0] or 0, r[1], r[2]) for r in found.collect()), key=str) == want
    got = sorted(centroids.collect())
    assert [list(r[1]) for r in got] == want_c and got[0][3] == sum(w[3] for w in want)
    assert all(r[2] == sum(w[3] for w in want if w[2] == r[0]) for r in got)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 6.0])], "vec_id long, embedding array<float>")
    found, centroids = clusters(df, k=40, width=2)
    assert sorted(r[2] for r in found.collect()) == [0, 0] and centroids.count() == 2
    for none in (df.limit(0), df.where("vec_id > 5")):
        found, centroids = clusters(none, width=2)
        assert found.count() == centroids.count() == 0
    with pytest.raises(Exception, match="64 bits"):
        clusters(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), width=1)[0].count()


def test_bounds_save_distances():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 200, (40, 64))
    x = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(0, 20, (3000, 64))).astype(np.int64)
    screen = Screen(np.floor(centres).astype(np.int64))
    found, d = screen.nearest(x)
    every = ((x[:, None] - screen.exact) ** 2).sum(axis=2)
    assert (d == every.min(axis=1)).all() and (found == every.argmin(axis=1)).all()
    assert screen.met < 0.2 * screen.pairs
