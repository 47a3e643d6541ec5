import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from twinspark.llm import decontaminate as module
from twinspark.llm.decontaminate import clean, decontaminate, index, matches, words
from twinspark.llm.packing import pack, public_tokenizer

ODD = [(1, "the cat sat on the mat " * 300, "x"), (2, None, "x"), (3, "", None), (None, "a null id", "y"), (4, "twice", "z"), (4, "twice", "z"), (5, "é 漢字 <|endoftext|> \n\n " * 50, "z")]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer()["json_path"])
    df = spark.createDataFrame(ODD, "doc_id long, text string, tier string")
    rows = pack(df, public_tokenizer()).collect()
    ids = defaultdict(list)
    for doc_id, text, _ in ODD:
        ids[doc_id].append(np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4"))
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.length))
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
    for doc_id, texts in ids.items():
        assert sum(n for _, n in spans[doc_id]) == sum(map(len, texts))
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert pack(df.limit(0), public_tokenizer()).count() == 0


def brute(docs, items, n=10):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: pat.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    out = []
    for doc_id, text in docs:
        w, hit, got = low(text), set(), set()
        for item_id, item in items:
            x = low(item)
            for i in range(max(1, len(x) - n + 1) if x else 0):
                p = x[i : i + n]
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        hit.update(range(s, s + len(p)))
                        got.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words,index_tokens,candidates", [(2_000_000, 1_000_000, 1_000_000), (40, 1_000_000, 1_000_000), (2_000_000, 500, 20)])
def test_decontamination_equals_brute_force(spark, monkeypatch, block_words, index_tokens, candidates):
    monkeypatch.setattr(module, "INDEX_TOKENS", index_tokens)
    monkeypatch.setattr(module, "CANDIDATES", candidates)
    bench = [(i, r["text"]) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect())] + [(100, "tiny one"), (101, None), (102, ""), (103, "..."), (9, "tiny ONE"), (None, "the of")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(1000 + i, f"Aa {t} zz {t}!" if t else t) for i, t in bench if i is not None] + [(None, "a tiny one"), (7, "tiny, ONE tiny one"), (7, "tiny, ONE tiny one")]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_hit int").repartition(3)
    out = decontaminate(df, spark.createDataFrame([(a, b, 2) for a, b in bench], "item_id long, text string, doc_id int"), block_words=block_words)
    got = sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()], key=str)
    assert got == brute(docs, [b for b in bench if b[0] is not None])
    assert out.limit(0).count() == 0
    none = decontaminate(df, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x b y a c z"), (2, "a q q q q b c"), (3, "c b"), (4, "c b a")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    got = {r.key: r.near for r in matches(docs, items, "doc_id", slop=1).collect()}
    assert got == {"1": [1], "2": [], "3": [], "4": [0]}


def test_index_has_every_token(spark):
    docs = [(1, "b a b"), (2, None), (3, ""), (4, "A  c"), (4, "A  c"), (None, "a b " * 3000)]
    blocks = index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), "doc_id").collect()
    got = []
    for b in blocks:
        tokens, at = {}, np.frombuffer(b.positions, np.int32)
        for i, term in enumerate(b.terms):
            tokens |= {int(p): bytes(term) for p in at[b.starts[i] : b.starts[i + 1]]}
        for d, begin, end in zip(b.docs, [0, *b.ends], b.ends):
            assert d.n_words == end - begin
            got.append((d.key, [tokens[p] for p in range(begin, end)]))
    assert sorted(got, key=str) == sorted(((None if k is None else str(k), words(t)) for k, t in docs), key=str)


def test_clean_removes_rows_not_ids(spark):
    docs = spark.createDataFrame([(1, "a tiny one", 5), (1, "another", 5), (None, "tiny one", 6), (None, None, 6), (2, "", 7), (2, "", 7)], "doc_id long, text string, block int")
    bench = spark.createDataFrame([("x", "tiny one")], "item_id string, text string")
    got = clean(docs, bench)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "another", 5), (None, None, 6), (2, "", 7), (2, "", 7)], key=str)
    assert clean(docs.limit(0), bench).count() == 0


def test_index_files_have_few_blocks(spark, monkeypatch):
    """A file's blocks are in memory together when it is written or read; a task with many documents writes many files."""
    monkeypatch.setattr(module, "INDEX_TOKENS", 20)
    stored = index(spark.createDataFrame([(i, "a b c d " * 5) for i in range(50)], "doc_id long, text string").coalesce(1), "doc_id")
    of_file = stored.groupBy("_metadata.file_path").count().collect()
    assert sum(r["count"] for r in of_file) == 50 and max(r["count"] for r in of_file) <= module.FILE_BLOCKS
