import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from twinspark.llm import induced, suffix
from twinspark.llm.induced import repeated, sorted_suffixes
from twinspark.llm.suffix import suffix_dedup


def brute(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit,base", [(1 << 20, 1 << 20), (64, 1 << 20), (64, 8), (1 << 20, 1)])
def test_suffixes_and_common_prefixes(limit, base):
    """In memory and on disk, with and without recursion, against a plain sort."""
    rng = np.random.default_rng(0)
    for k in range(120):
        t = rng.integers(0, 1 + k % 5, int(rng.integers(0, 150))).astype(np.uint8)
        b = t.tobytes() * (1 + k % 3)
        order = sorted(range(len(b)), key=lambda i: b[i:])
        common = [0] * bool(b) + [len(os.path.commonprefix([b[x:], b[y:]])) for x, y in zip(order, order[1:])]
        got, lcp = sorted_suffixes(np.frombuffer(b, np.uint8), 256, limit, base)
        assert got.tolist() == order and lcp.tolist() == common


def test_depth_is_enough():
    rng = np.random.default_rng(1)
    for k in range(60):
        t = rng.integers(97, 99 + k % 4, 300).astype(np.uint8)
        t = np.concatenate([t, t[50:250], t[: k + 1]])
        b, depth = t.tobytes(), 5 + k % 40
        count = Counter(b[i : i + depth] for i in range(len(b) - depth + 1))
        valid = np.arange(len(b)) + depth <= len(b)
        for base in (1 << 20, 4):
            hit = repeated(t, valid, depth, 64, base)
            assert hit.tolist() == [bool(v) and count[b[i : i + depth]] > 1 for i, v in enumerate(valid)]


def test_blocks_use_the_disk(monkeypatch):
    """At production parameters the queues of a block are on disk; a block whose names outgrow `BASE` recurs."""
    rng, made, depth = np.random.default_rng(2), [], []
    queue, sort = induced.Queue, induced.sorted_suffixes
    monkeypatch.setattr(induced, "Queue", lambda *a: (made.append(queue(*a)), made[-1])[1])
    monkeypatch.setattr(induced, "sorted_suffixes", lambda *a: (depth.append(len(a[0])), sort(*a))[1])
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(5000)]
    text = " ".join(words[i] for i in rng.integers(0, 5000, suffix.BLOCK_BYTES // 7))
    t = np.frombuffer((text + " " + text[1000:3000]).encode(), np.uint8)
    hit = repeated(t, np.arange(len(t)) + 400 <= len(t), 400, base=1 << 17)
    assert all(q.on_disk for q in made[:2] + made[-2:]) and len(depth) > 1
    assert hit[1000:2601].all() and hit[len(text) + 1 : len(text) + 1602].all() and hit.sum() == 2 * 1601


@pytest.mark.parametrize("key_bytes,block_bytes", [(8 << 20, 4 << 20), (300, 500), (0, 1)])
def test_equals_brute_force(spark, key_bytes, block_bytes):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(12), text(20), text(40)]
    docs = [(i, "".join(rng.choice([text(rng.randrange(9)), rng.choice(shared), rng.choice(shared)[5:-3]]) for _ in range(rng.randrange(5)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "a" * 400), (503, "ab" * 200 + "x"), (None, shared[2]), (None, "own " + shared[1]), (3, docs[3][1]), (504, "z" * 31)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_bytes int").repartition(3)
    got = suffix_dedup(df, 32, 16, key_bytes=key_bytes, block_bytes=block_bytes).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, 32)
    assert suffix_dedup(df.limit(0)).count() == 0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [tuple(r) for r in suffix_dedup(df).drop("spans").collect()]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in df.collect()], 400)
    assert sum(r[2] for r in got) > 0


def test_rows_told_grow_with_the_runs(spark, monkeypatch):
    """200 texts share a passage: what repeats is told once a run, and a place meets few rows."""
    rng = random.Random(8)
    own = lambda: "".join(rng.choice("abcdefgh") for _ in range(150))
    passage = own()
    df = spark.createDataFrame([(i, own() + passage + own()) for i in range(200)] + [(900 + i, own()[:40] + passage) for i in range(3)] * 2, "doc_id long, text string")
    seen = {}

    def spy(table, name):
        seen[name] = written(table, name)
        return seen[name]

    written = suffix.materialize
    monkeypatch.setattr(suffix, "materialize", spy)
    for key_bytes in (1 << 20, 0):
        got = suffix_dedup(df, 64, 16, key_bytes=key_bytes).drop("spans").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in df.collect()], 64)
        assert seen["found"].count() <= 2 * seen["kinds"].count() and seen["places"].join(seen["found"], ["key", "digest"]).count() <= 2 * seen["places"].count()
