import random
import re

import pytest

from twinspark.llm.substring import LINES, PARAGRAPHS, SENTENCES, cut, cuts, nested_units, removed_spans, repeated_units, units

A, B = "a line of five words here", "another line of five words"


@pytest.mark.parametrize("separator", [LINES, PARAGRAPHS])
def test_keeps_the_earliest_and_offsets(spark, separator):
    sep = "\n" if separator == LINES else "\n\n"
    rows = [(5, sep.join([A, B, "short"])), (2, sep.join(["é" + B, A.upper() + "  "])), (9, sep.join([B, B])), (None, A), (7, None), (8, ""), (11, "x " * 100_000 + sep + A), (5, "short")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    got = repeated_units(df, separator=separator, inner=None, min_words=5, long=0).collect()
    text = {i: t for i, t in rows if t and t != "short"}
    for r in got:
        assert text[r.doc_id][r.start : r.stop].lower().split() == text[r.kept_doc_id][r.kept_start :].lower().split()[: len(text[r.doc_id][r.start : r.stop].split())]
    assert sorted(((r.doc_id, r.start) for r in got), key=str) == sorted([(5, 0), (9, 0), (9, len(B + sep)), (None, 0), (11, 200_000 + len(sep))], key=str)
    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in removed_spans(repeated_units(df, separator=separator, inner=None, min_words=5, long=0)).collect()}
    assert cut(text[9], spans[9]) == sep and cut(text[5], spans[5]) == sep + B + sep + "short"
    assert repeated_units(df.limit(0)).count() == 0


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, A), (1, A), (1, A)], "doc_id long, text string").repartition(3)
    assert [(r.doc_id, r.occurrences, r.kept_doc_id) for r in repeated_units(df, min_words=5).collect()] == [(1, 3, 1)] * 2


def test_units_trim_and_skip():
    assert [(a, b) for a, b, _ in units("  a b \n\nc\n", re.compile(LINES), 1)] == [(0, 6), (8, 9)]
    assert list(units(None, re.compile(LINES), 1)) == list(units("", re.compile(LINES), 0)) == []


def test_passages_within_lines(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(5, 60))) + " " + (passage if i < 10 else word()) + " " + " ".join(word() for _ in range(50))) for i in range(20)]
    got = repeated_units(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(1, 10)) and {r.kept_doc_id for r in got} == {0}
    assert all(dict(docs)[r.doc_id][r.start : r.stop].strip() in passage for r in got)


def test_units_partition_a_text():
    text = "One two three. Four five!\n" + " ".join(f"w{i % 17}x{i}" for i in range(300)) + "\t end. "
    got = list(units(text, re.compile(SENTENCES), 1))
    assert len(got) > 10 and all(text[a:b].lower().split() == u.decode().split() for a, b, u in got)
    assert cuts(["a"] * 100) == []


def test_lines_of_short_sentences(spark):
    verse = "Roses are red. Violets are blue. Sugar is sweet. So are you."
    rows = [(1, "own start\n" + verse), (2, verse + "\nown end of it"), (3, "Roses are red."), (4, "x. " + verse)]
    got = repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start, r.stop, r.kept_doc_id, r.kept_start) for r in got] == [(2, 0, len(verse), 1, 10)]
    units_of = list(nested_units("One two. Three four.\nfive\n\n six ", re.compile(LINES), re.compile(SENTENCES), 1))
    assert [(a, b) for a, b, _ in units_of] == [(0, 8), (9, 20), (0, 20), (21, 25), (27, 32)]
    assert cut("abcdefgh", [(0, 3), (1, 2), (2, 5)]) == "fgh"
