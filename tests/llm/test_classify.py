import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspark.llm import queries
from twinspark.llm.classify import LETTERS, fit_language, fit_toxicity, fold, language, toxicity
from twinspark.llm.subword import runs, train

SF = "/root/testdata/sf0.01"


def test_runs_cover_every_word():
    for n in range(0, 60):
        for w in (2, 3, 12):
            seen = {i for s in runs(n, w) for i in range(s, min(n, s + w))}
            assert seen == set(range(n))


def test_toxicity_held_out(spark):
    rows = queries.op6_toxicity(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    m = rows[rows.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    # few rows are labelled here; a constant answer is right in 0.87 of them and finds none of the toxic ones
    assert m.predicted[m.toxic == 1].mean() >= 0.5 and m.predicted[m.toxic == 0].mean() <= 0.03


def test_language_held_out(spark):
    rows = queries.op7_language_id(spark, SF).toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    m = rows[rows.held_out].merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (m.lang_pred == m.lang).mean() > 0.98


@pytest.mark.parametrize("classes", [0, 1, 2])
def test_odd_rows(spark, classes):
    texts = ["the cat and the dog sat"] * 60 + ["der hund und die katze"] * 60
    labels = (["en"] * 60 + ["de"] * 60)[: 60 * classes]
    model = train(texts[: len(labels)], labels, LETTERS)
    rows = [(1, "the dog", "x"), (2, None, "x"), (3, "", None), (None, "die katze", "x"), (5, "12 34 !", "x"), (5, "12 34 !", "x"), (7, "½ ² ٣", "x"), (6, "der und " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language(df, model).collect()}
    assert [got[i].lang_pred for i in (2, 3, 5, 7)] == ["und"] * 4 and got[5].score == 0
    assert [got[i].lang_pred for i in (1, None, 6)] == [["und"] * 3, ["en"] * 3, ["en", "de", "de"]][classes]
    assert language(df.limit(0), model).count() == 0
    toxic = train(["you idiot " * 10, "nice day " * 10] * (40 * (classes > 0)), ([1, 0] if classes == 2 else [1, 1]) * (40 * (classes > 0)), LETTERS, window=4)
    out = {r.doc_id: r for r in toxicity(df, toxic).collect()}
    assert all(0 <= r.score <= 1 for r in out.values())
    if classes == 0:
        assert all(r.score == 0 for r in out.values())


def naive(model, text):
    """Probabilities by the definition: n-grams of each word, means, runs, softmax; plain Python."""
    size, words = len(model.parts), re.findall(model.pattern, (text or "").lower())

    def vector(word):
        s = f"<{word}>"
        pieces = [(s, 0)] + [(s[i : i + n], n) for n in (3, 4, 5) if n < len(s) for i in range(len(s) - n + 1)]
        return np.mean([model.parts[zlib.crc32(p.encode("utf-8", "surrogatepass"), n) % size].astype(float) for p, n in pieces], axis=0)

    if not words:
        bags = [np.zeros(model.parts.shape[1])]
    elif model.window is None or len(words) <= model.window:
        bags = [np.mean([vector(w) for w in words], axis=0)]
    else:
        starts = {*range(0, len(words) - model.window + 1, model.window // 2), len(words) - model.window}
        bags = [np.mean([vector(w) for w in words[s : s + model.window]], axis=0) for s in sorted(starts)]
    z = (max(bags, key=lambda v: v[-1] - v[0]) + model.bias) * model.slope
    z[-1] += model.shift
    e = np.exp(z - z.max())
    return e / e.sum()


def test_scores_equal_a_naive_scorer(spark):
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
    toxic = fit_toxicity(docs, spark.read.parquet(f"{SF.replace('0.01', '0.001')}/labels.parquet"), held)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity(docs, toxic).collect():
        assert abs(r.score - naive(toxic, text[r.doc_id])[1]) < 1e-6
    lang = fit_language(docs, held)
    for r in language(docs, lang).collect():
        p = naive(lang, text[r.doc_id])
        assert r.lang_pred == "und" or abs(r.score - p.max()) < 1e-6 and r.lang_pred == lang.classes[int(p.argmax())]


def test_fits_on_odd_rows(spark):
    no = F.lit(False)
    texts = [(i, ("you rotten fool " if i % 2 else "a nice warm day ") * 5, ("de", "en")[i % 2]) for i in range(120)]
    odd = [(None, "you fool", "en"), (500, None, "en"), (501, "", None), (3, "you rotten fool", "en"), (7, "x " * 100_000, "fr")]
    docs = spark.createDataFrame([(*r, 1) for r in texts + odd], "doc_id long, text string, lang string, toxic int")
    rows = [(i, i % 2) for i in range(120)] + [(None, 1), (5, None), (5, 0), (5, 7), (500, 1), (501, 0), (9999, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int").withColumn("text", F.lit("other"))
    model = fit_toxicity(docs, labels, no)
    got = {r.doc_id: r.predicted for r in toxicity(docs.where("doc_id < 20"), model).collect()}
    assert model.classes == [0, 1] and sum(got[i] == i % 2 for i in range(20)) >= 19
    assert fit_language(docs, no).classes == ["de", "en", "fr"]
    for d, y in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs, labels.where("doc_id is null"))):
        empty = fit_toxicity(d, y, no)
        assert [r.score for r in toxicity(docs.limit(3), empty).collect()] == [0.0] * 3
    assert fit_language(docs.limit(0), no).classes == fit_language(docs, F.lit(True)).classes == []
    many = spark.createDataFrame([(i, f"wort{i % 260} " * 3, f"l{i % 260:03d}") for i in range(1040)], "doc_id long, text string, lang string")
    assert len(fit_language(many, no).classes) == 260  # no language is left out
