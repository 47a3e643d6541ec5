import zlib
from itertools import groupby

import pytest
import xxhash

from twinspark.llm import queries
from twinspark.llm.sharding import shard


def check(rows, shards):
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    return [sum(r.size for r in rows if r.shard == s) for s in range(shards)]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_sizes_and_groups(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = queries.op3_sampled_splitters(spark, path).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    sizes, most = check(rows, 24), max(r.size for r in rows)
    mean = sum(sizes) / 24
    assert all(abs(x - mean) <= most + mean / 16 for x in sizes)
    home = {}
    for r in rows:
        home.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(x) == 1 for x in home.values())


def test_equals_one_sort_of_all_rows(spark):
    """Whatever splitters were drawn, texts stand in the order of their hash, and a text goes where the middle of its bytes lies."""
    path = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    key = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >> 63 else 0)
    order = sorted((key(t), i, len(t.encode()) + 8) for i, t in docs)
    total, at, want, slots = sum(n for *_, n in order), 0, {}, [0] * 24
    for _, rows in groupby(order, key=lambda r: r[0]):
        rows = list(rows)
        size = sum(n for *_, n in rows)
        shard_ = min(23, (2 * at + size) * 24 // (2 * total))
        for _, i, _ in rows:
            want[i] = (shard_, slots[shard_])
            slots[shard_] += 1
        at += size
    assert {r.doc_id: (r.shard, r.slot) for r in queries.op3_sampled_splitters(spark, path).collect()} == want


def test_hot_text_is_cut(spark):
    rows = [(i, "the same text") for i in range(3000)] + [(5000 + i, f"text {i} " * (i % 7)) for i in range(3000)] + [(None, None), (1, None), (1, ""), (4, "the same text")]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, shard int").repartition(5)
    got = shard(df, shards=8, ranges=64).collect()
    sizes = check(got, 8)
    assert len(got) == len(rows) and max(sizes) - min(sizes) < 0.2 * sum(sizes) / 8
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"the same text")}) >= 4
    assert shard(df.limit(0)).count() == 0
    assert [r.shard for r in shard(df.limit(1)).collect()] and len(shard(df.limit(1)).collect()) == 1
