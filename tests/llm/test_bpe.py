import hashlib
import random

import pytest
import tiktoken

from twinspark.llm import bpe
from twinspark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.public_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    every = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    out = ["", None, "a" * 5000, "the cat's  \n\n  sat, isn't it?  ", " " * 3000 + "x", "日本語のテキスト。" * 20, "<|endoftext|> twice twice"]
    out += [" ".join(map(chr, every[i::40])) for i in (0, 7)]  # letters of scripts that only some releases of Unicode have
    return out + ["".join(rng.choice(" ab\nc'sé日7½  \x1c.!") for _ in range(rng.randrange(60))) for _ in range(200)]


@pytest.mark.parametrize("most", [1 << 20, 3, 0])
def test_equals_the_library(spark, vocabulary, library, most):
    given = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)] + [(None, "a b", "x"), (3, given[3], "x")], "doc_id long, text string, ids string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), bytes(r.bytes)) for r in bpe.decode(bpe.encode(df, vocabulary, most=most), vocabulary).collect())
    want = [(False, i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(given)]
    want += [(True, 0, library.encode_ordinary("a b"), b"a b"), want[3]]
    assert got == sorted(want)
    both = bpe.encode(df, vocabulary, packed=True, decoded=True, most=most).collect()
    assert sorted((bytes(r.ids), bytes(r.bytes)) for r in both) == sorted((b"".join(x.to_bytes(4, "little") for x in ids), raw) for _, _, ids, raw in want)


def test_odd_tables(spark, vocabulary):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert bpe.decode(bpe.encode(empty, vocabulary), vocabulary).count() == 0
    nulls = spark.createDataFrame([("a", None), (None, None)], "doc_id string, text string")
    assert [(list(r.ids), bytes(r.bytes)) for r in bpe.decode(bpe.encode(nulls, vocabulary), vocabulary).collect()] == [([], b"")] * 2
    ids = spark.createDataFrame([(None, 1), ([], 2), ([0, 50255], 3)], "ids array<int>, `a.b` int")
    out = {r[1]: r[2] and bytes(r[2]) for r in bpe.decode(ids, vocabulary).collect()}
    assert out == {1: None, 2: b"", 3: vocabulary.pieces[0] + vocabulary.pieces[50255]}


def test_heap_equals_the_library(vocabulary, library):
    rng = random.Random(3)
    for n in (1, 2, 50, 3000):
        word = "".join(rng.choice("abcdefgh") for _ in range(n))
        assert bpe.by_heap(vocabulary.ranks, word.encode()) == library.encode_ordinary(word)


def test_ranks_are_a_constant_and_words_are_not_shuffled(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b a b")], "doc_id long, text string")
    plan = bpe.encode(df, vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "Exchange" not in plan


def test_query_equals_the_library(spark, vocabulary, library):
    sf = "/root/testdata/sf0.001"
    u32 = lambda ids: b"".join(i.to_bytes(4, "little") for i in ids)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(u32(ids)), sha((r.text or "").encode())))
    assert sorted(map(tuple, QUERIES["op11_byte_bpe"](spark, sf).collect())) == sorted(want)
