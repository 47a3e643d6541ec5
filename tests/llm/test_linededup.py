import random

import pytest

from twinspark.llm.linededup import dedup_lines, removed_runs, winnow


def test_winnow_guarantees_a_fingerprint():
    rng = random.Random(0)
    for _ in range(200):
        h = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        for w in (1, 2, 4):
            at = set(winnow(h, w))
            assert all(at & set(range(i, i + w)) for i in range(len(h) - w + 1))


def brute(docs, t):
    """Lines that go of each (doc_id, text)."""
    lines = {d: [x.lower().split() for x in (d[1] or "").split("\n") if x.split()] for d in docs}
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    seen, gone = {}, {}
    for d in order:
        for i in range(len(lines[d]) - t + 1):
            seen.setdefault(str(lines[d][i : i + t]), []).append((d[0] is None, d[0] or 0, i, d))
    for places in seen.values():
        for _, _, i, d in sorted(places, key=lambda p: p[:3])[1:]:
            gone.setdefault(d, set()).update(range(i, i + t))
    return gone


@pytest.mark.parametrize("gram,window", [(2, 2), (1, 1), (1, 3), (3, 2)])
def test_equals_brute_force(spark, gram, window):
    rng = random.Random(gram * 10 + window)
    docs = [(i, "\n".join(rng.choice(["aa b", "Aa  b", "c", "d e", "f", "", "  ", f"own {rng.random()}"]) for _ in range(rng.randrange(0, 14)))) for i in range(150)]
    docs += [(900, None), (None, "aa b\nc\nd e\nf"), (901, ""), (902, "c\n" * 3000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, line int").repartition(3)
    gone = {}
    for r in removed_runs(df, gram=gram, window=window).collect():
        gone.setdefault(r.doc_id, set()).update(range(r.line, r.line + r.lines))
        text = dict(docs)[r.doc_id]
        assert len([x for x in text[r.start : r.stop].split("\n") if x.split()]) == r.lines
    assert gone == {d[0]: g for d, g in brute(docs, gram + window - 1).items()}
    out = {r.doc_id: r for r in dedup_lines(df, gram=gram, window=window).collect()}
    assert len(out) == len(docs) and all(r.line == 1 for r in out.values())
    for d, text in docs:
        keep = [x for i, x in enumerate(x for x in (text or "").split("\n") if x.split()) if i not in gone.get(d, ())]
        assert [x for x in (out[d].text or "").split("\n") if x.split()] == keep
    assert dedup_lines(df.limit(0)).count() == removed_runs(df.limit(0)).count() == 0


def test_short_runs_of_many_words(spark):
    """Against brute force: later runs go that have three lines, or fewer of eight words together."""
    rng = random.Random(5)
    one, pair, wide = "one line of nine words that stands by itself", ["five words in this line", "and four words more"], "\u6f22\u5b57" * 10
    pool = [one, one.upper(), *pair, wide, "short one", "a b c", "x", "", "eight words make a line that goes wholly"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 5)))) for i in range(60)]
    docs += [(100, one), (101, one + "\nown"), (102, "own 2\n" + "\n".join(pair)), (103, wide), (104, "short one"), (None, one), (105, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lines = {d: [" ".join(x.lower().split()) for x in (t or "").split("\n") if x.split()] for d, t in docs}
    words, seen, gone = (lambda x: 10 if x == wide else len(x.split())), set(), {}
    for d, _ in docs[:-2] + docs[-1:] + docs[-2:-1]:
        for i in range(len(lines[d])):
            for n in (1, 2, 3):
                part = lines[d][i : i + n]
                if len(part) == n and (n == 3 or sum(map(words, part)) >= 8):
                    if tuple(part) in seen:
                        gone.setdefault(d, set()).update(range(i, i + n))
                    seen.add(tuple(part))
    assert gone[101] == {0} and gone[102] == {1, 2} and gone[100] == gone[103] == gone[None] == {0} and 104 not in gone
    got = {}
    for r in removed_runs(df, min_words=8).collect():
        got.setdefault(r.doc_id, set()).update(range(r.line, r.line + r.lines))
    assert got == gone
    for r in dedup_lines(df, min_words=8).collect():
        assert [" ".join(x.lower().split()) for x in (r.text or "").split("\n") if x.split()] == [x for i, x in enumerate(lines[r.doc_id]) if i not in gone.get(r.doc_id, ())]
    assert 101 not in {r.doc_id for r in removed_runs(df).collect()}


def test_clashing_names_and_long_texts(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(30_000))
    rows = [(1, long, 1, 2, 3, 4), (2, "own\n" + long, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int, __hash int, first int, `a.b` int").withColumnsRenamed({"first": "runs"})
    out = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert out[1].text == long and out[2].text == "own\n" and dedup_lines(df).columns == df.columns
    assert out[2]["__id"] == 1 and out[2]["__hash"] == 2 and out[2]["runs"] == 3 and out[2]["a.b"] == 4
