"""The cascaded search against a plain Python replay, query by query."""

import numpy as np
import pytest

from twinspark.operators.cascade import SearchOptions, search


def replay(q, vecs, hashes, frames, buckets, o, reranked=True):
    """[(id, score, hash only)] of query q by falling score, then id."""
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    ids = range(len(vecs))
    hits = sorted(((1 - (hashes[q] ^ hashes[i]).bit_count() / 64, i) for i in ids if (hashes[q] ^ hashes[i]).bit_count() <= o.max_distance), key=lambda x: (-x[0], x[1]))
    if o.hash_only and hits:
        return [(i, s, True) for s, i in hits if s >= o.threshold]
    stage1 = sorted(((round(float(unit[q] @ unit[i]), 9), i) for i in ids if buckets[q] in ("unknown", buckets[i])), key=lambda x: (-x[0], x[1]))[: o.top_k]
    cand = [(i, s) for s, i in stage1 if s >= o.threshold * 0.5]
    cand += [(i, s) for s, i in hits if i not in {c for c, _ in cand}]
    if reranked:
        sure = [(i, s) for i, s in cand if s >= o.skip_from]
        rest = [(i, s) for i, s in cand if s < o.skip_from][: o.rerank_most]
        again = []
        for i, _ in rest:
            if len(frames[q]) >= o.min_frames and len(frames[i]) >= o.min_frames:
                m = np.clip(frames[q] @ frames[i].T, -1, 1) / 2 + 0.5
                again.append((i, round(float(m.max(axis=1).mean()), 9)))
        cand = sure + again
    in_stage1, in_hits = {i for _, i in stage1}, {i for _, i in hits}
    found = [(i, s, i in in_hits and i not in in_stage1) for i, s in cand if s >= o.threshold]
    return sorted(found, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("reranked", [True, False])
@pytest.mark.parametrize("o", [SearchOptions(top_k=5, threshold=0.5), SearchOptions(top_k=8, threshold=0.95, hash_only=True), SearchOptions(top_k=8, threshold=0.6, max_distance=12, rerank_most=2), SearchOptions(top_k=3, threshold=0.3, hash_only=True, max_distance=0)])
def test_search(spark, o, reranked):
    rng = np.random.default_rng(o.top_k + reranked)
    vecs = rng.normal(size=(24, 6))
    vecs[1], vecs[2] = vecs[0] + 0.01, vecs[0] + 0.4 * rng.normal(size=6)
    hashes = [int(x) for x in rng.integers(0, 1 << 62, 24)]
    hashes[5], hashes[6], hashes[7] = hashes[0] ^ 0b111, hashes[0] ^ 0b11111, hashes[3]
    frames = [rng.normal(size=(n, 4)) / 2 for n in rng.integers(2, 8, 24)]
    buckets = [("a", "b", "unknown")[i % 3] for i in range(24)]
    rows = [(i, v.tolist(), b) for i, (v, b) in enumerate(zip(vecs, buckets))]
    index = spark.createDataFrame(rows, "video_id long, v array<double>, bucket string").repartition(3)
    h = spark.createDataFrame(list(enumerate(hashes)), "video_id long, h long")
    f = spark.createDataFrame([(i, j, x.tolist()) for i, part in enumerate(frames) for j, x in enumerate(part)], "video_id long, frame_idx long, f array<double>")
    got = {}
    for r in search(index.withColumnRenamed("video_id", "query_id"), index, h, h, f if reranked else None, o, ["bucket"]).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.video_id, r.score, r.phash_only))
    for q in range(24):
        want = [(n + 1, i, round(s, 4), only) for n, (i, s, only) in enumerate(replay(q, vecs, hashes, frames, buckets, o, reranked))]
        have = sorted(got.get(q, []))
        assert [x[:2] + x[3:] for x in have] == [x[:2] + x[3:] for x in want] and np.allclose([x[2] for x in have], [x[2] for x in want], atol=1e-4)
