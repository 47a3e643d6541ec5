"""Toxicity and language identification over subword embeddings (see `subword`)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinspark.llm.subword import Model, train

#: Words of letters, digits and what misspellings put inside words.
TOXIC_WORDS = r"[^\W_]+(?:[@$*!_'][^\W_]+)*"
#: Words of a bag; a text is as toxic as its most toxic bag.
WINDOW = 6
LETTERS = r"[^\W\d_]+"
#: At most about so many labelled rows train a model (half of them for each label, or a share for each language).
TOXIC_SAMPLE = 6_000
LANGUAGE_SAMPLE = 2_000
#: Rows of a language that train at least, however many languages there are.
LEAST = 20


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def _draw(df: DataFrame, class_col: str, id_col: str, per_class: int) -> tuple[DataFrame, dict]:
    """About `per_class` rows of each class, drawn by a hash of the id; the classes' counts (a row for each class, as the
    model itself has)."""
    counts = {r[0]: r[1] for r in df.groupBy(class_col).count().orderBy(class_col).collect()}
    if not counts:
        return df.limit(0), {}
    rates = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(min(1.0, per_class / n)))])
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(u < F.try_element_at(rates, F.col(class_col))), counts


def fit_toxicity(documents: DataFrame, labels: DataFrame, holds_out: Column, sample: int = TOXIC_SAMPLE) -> Model:
    """A model of `labels.toxic` from labelled documents where `holds_out` is false; reads text and toxic alone.

    Rows without id or label take no part; null texts count as empty; a document with several labels, or an id with
    several texts, counts for each; no labelled document gives a model without classes. Texts come to the driver whole:
    `sample` bounds their number, not their bytes. Other columns aren't read.
    """
    y = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~holds_out & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    drawn, counts = _draw(y, "toxic", "doc_id", sample // 2)
    # `drawn` has about `sample` rows whatever the input, so it may be broadcast
    rows = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic").toPandas() if counts else None
    if rows is None or not len(rows):
        return train([], [], TOXIC_WORDS)
    rows = rows.sort_values(["doc_id", "toxic", "text"], na_position="first")
    total = sum(counts.values())
    return train(rows.text.tolist(), rows.toxic.tolist(), TOXIC_WORDS, prior={c: n / total for c, n in counts.items()}, window=WINDOW, steps=1_500, batch=64)


def toxicity(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, `keep`, score (probability of label 1) and predicted. Null and empty texts get the score of the bias alone;
    a model without rows says 0; whole texts are read, however long; repeated rows are each answered, an empty table with
    none; `keep` may have any names but `score`, `predicted` and `__text`."""
    spec = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = spec.value.scorer()
        at = spec.value.classes.index(1) if 1 in spec.value.classes else None
        for b in batches:
            got = [0.0 if at is None else float(score(t.as_py())[0][at]) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())], [*b.schema.names[:-1], "score", "predicted"])

    return _scored(documents, (id_col, *keep), text_col, run, "score double, predicted int")


def _scored(df: DataFrame, names: tuple[str, ...], text_col: str, run, more: str) -> DataFrame:
    inner = df.select(*names, F.col(text_col).alias("__text"))
    # names in structs may hold dots, which DDL can't tell
    return inner.mapInArrow(run, StructType(inner.schema.fields[:-1] + StructType.fromDDL(more).fields))


def fit_language(documents: DataFrame, holds_out: Column, sample: int = LANGUAGE_SAMPLE, least: int = LEAST) -> Model:
    """A model of `lang` from documents where `holds_out` is false; rows without lang, id or text take no part.

    Every language is learned, from a like share of `sample` rows, `least` at least. Repeated rows count each; no row gives
    a model without classes. Texts come to the driver whole: rows are bounded, not bytes. Other columns aren't read.
    """
    y = documents.select("doc_id", "text", "lang").where(~holds_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = max(1, y.agg(F.count_distinct("lang")).first()[0])
    drawn, counts = _draw(y, "lang", "doc_id", max(least, sample // n))
    rows = drawn.toPandas().sort_values(["doc_id", "lang", "text"]) if counts else None
    if rows is None or not len(rows):
        return train([], [], LETTERS)
    total = sum(counts.values())
    return train(rows.text.tolist(), rows.lang.tolist(), LETTERS, prior={c: k / total for c, k in counts.items()}, steps=200)


def language(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, `keep`, lang_pred, score and rejected. `und` with score 0 for null texts, texts without letters, and where nothing
    was learned; whole texts are read, however long; repeated rows are each answered, an empty table with none; `rejected` marks those and predictions whose confidence is under the model's calibrated threshold."""
    spec = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, score = spec.value, spec.value.scorer()
        for b in batches:
            lang, conf = [], []
            for t in b.column(b.num_columns - 1):
                p, n = score(t.as_py())
                i = int(p.argmax())
                # a digit form like a half is a word character, but no letter
                known = n > 0 and len(m.classes) > 0 and any(map(str.isalpha, t.as_py()))
                lang.append(m.classes[i] if known else "und")
                conf.append(float(p[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(conf, pa.float64()), pa.array([x == 0 or x < m.reject_below for x in conf], pa.bool_())], [*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    return _scored(documents, (id_col, *keep), text_col, run, "lang_pred string, score double, rejected boolean")
