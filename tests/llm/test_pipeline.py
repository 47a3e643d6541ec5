import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np

import corpus_pipeline as cp
from twinspark.llm.packing import Encoder, public_tokenizer
from twinspark.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.toPandas())
    first = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    gone = labels[~labels.doc_id.isin(seen[0].doc_id)]
    assert 0.85 * len(first) < len(seen[0]) < len(first) and gone.toxic.mean() > 0.8
    assert len(seen[1]) == len(seen[0]) and (seen[1].n_chars == seen[1].text.str.len()).all() and seen[1].n_chars.sum() < seen[0].n_chars.sum()
    # near duplicates by brute force: groups of texts whose sets of five-word shingles have a similarity of 0.8 or more
    sets, holders, common = {d: set(shingle_hashes(t, 5).tolist()) for d, t in zip(seen[1].doc_id, seen[1].text)}, defaultdict(list), defaultdict(int)
    for d, found in sets.items():
        for h in found:
            holders[h].append(d)
    for ids in holders.values():
        for pair in combinations(ids, 2):
            common[pair] += 1
    group = {d: d for d in sets}
    for (a, b), n in sorted(common.items()):
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) and group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {d: new if g == old else g for d, g in group.items()}
    empty = min((d for d in sets if not sets[d]), default=None)
    group |= {d: empty for d in sets if not sets[d]}
    kept, heads = sorted(seen[2].doc_id), set(group.values())
    assert sum(d not in kept for d in heads) <= 0.01 * len(heads)  # hardly a document goes that is in no group
    assert len(group) - len(heads) > 40 and len(set(kept) - heads) <= 0.1 * (len(group) - len(heads))
    assert set(seen[3].doc_id) < set(kept)
    encode, spans = Encoder(**public_tokenizer()), defaultdict(int)
    ids = {d: np.append(encode(t), np.uint32(0)).astype("<u4") for d, t in zip(seen[3].doc_id, seen[3].text)}
    for r in seen[4].itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        spans[r.doc_id] += r.length
    assert spans == {d: len(x) for d, x in ids.items()}
    assert cp.run(spark, SF).groupBy().sum("length").first()[0] == sum(spans.values())


def test_stages_with_odd_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en", "s", 0, 1.0), (2, text, None, None, None, 2.0), (None, text, "en", "s", 5, 3.0), (4, None, "en", "s", None, None), (5, "", "en", "s", 0, 0.0), (5, "", "en", "s", 0, 0.0), (6, "w " * 30_000, "en", "s", 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").withColumnRenamed("score", "a.b")
    for part in (docs, docs.limit(0)):
        now = part
        for name, stage in cp.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns, name
        ids = sorted((r.doc_id for r in now.collect()), key=str)
        assert ids == ([] if part is not docs else [1, 4, 6, None])
        assert {r.doc_id for r in cp.STAGES[-1][1](spark, now, SF).collect()} == set(ids)
