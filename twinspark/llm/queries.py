"""The thin queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.llm.common import read
from twinspark.sources.package import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.packing import pack, public_tokenizer

    return pack(read(spark, sf_dir, "documents"), public_tokenizer())


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.decontaminate import decontaminate

    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op8_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
dg AS (SELECT doc_id, l.n, i, array_to_string(w[i:i + l.n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(w) - l.n + 2)) AS t(i)),
m AS (SELECT doc_id, i, n, item_id FROM dg JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.classify import fit_toxicity, fold, toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
    model = fit_toxicity(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"), held)
    return toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.classify import fit_language, fold, language

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(True))
    return language(docs, fit_language(docs, held)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_bits=4, n_words=1, route=None)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.substring import repeated_units

    return repeated_units(read(spark, sf_dir, "documents"))


ORACLES["op1_substring_dedup"] = r"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\f\r]', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
u AS (SELECT doc_id, t.i AS pos, parts[t.i] AS unit FROM p, unnest(range(1, len(parts) + 1)) AS t(i)),
s AS (SELECT doc_id, pos, unit, length(unit) AS n, CAST(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(unit) - 1 AS BIGINT) AS start FROM u),
w AS (SELECT *, start + n AS stop, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS norm FROM s),
l AS (SELECT doc_id, pos, start, stop, norm, len(string_split(norm, ' ')) AS words, string_split(regexp_replace(lower(unit), '\s', ' ', 'g'), ' ') AS parts FROM w WHERE norm <> ''),
x AS (SELECT doc_id, pos, start, stop, t.i AS i, parts[t.i] AS word, start + sum(length(parts[t.i]) + 1) OVER (PARTITION BY doc_id, pos ORDER BY t.i) - length(parts[t.i]) - 1 AS place FROM l, unnest(range(1, len(parts) + 1)) AS t(i) WHERE words > 40),
y AS (SELECT *, row_number() OVER o - 1 AS k, md5(word || ' ' || lead(word) OVER o)[1:8] AS h FROM x WHERE word <> '' WINDOW o AS (PARTITION BY doc_id, pos ORDER BY i)),
z AS (SELECT *, h < min(h) OVER (o ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AND h < min(h) OVER (o ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)
  AND count(h) OVER (o ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) = 15 AS cut FROM y WINDOW o AS (PARTITION BY doc_id, pos ORDER BY k)),
q AS (SELECT *, sum(CAST(coalesce(cut, FALSE) AS INT)) OVER (PARTITION BY doc_id, pos ORDER BY k) AS piece FROM z),
r AS (SELECT doc_id, pos, piece, CASE WHEN piece = 0 THEN min(start) ELSE min(place) END AS start, max(stop) AS unit_stop, string_agg(word, ' ' ORDER BY k) AS norm FROM q GROUP BY doc_id, pos, piece),
c AS (SELECT doc_id, start, stop, norm FROM l WHERE words <= 40 UNION ALL
  SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id, pos ORDER BY piece), unit_stop), norm FROM r),
lp AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lu AS (SELECT doc_id, t.i AS pos, parts[t.i] AS unit FROM lp, unnest(range(1, len(parts) + 1)) AS t(i)),
ls AS (SELECT doc_id, unit, CAST(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(unit) - 1 AS BIGINT) AS start FROM lu),
lw AS (SELECT doc_id, start, start + length(unit) AS stop, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS norm FROM ls),
a AS (FROM c UNION ALL SELECT lw.doc_id, lw.start, lw.stop, any_value(lw.norm) FROM lw JOIN c ON c.doc_id = lw.doc_id AND c.start >= lw.start AND c.start < lw.stop GROUP BY ALL HAVING count(*) > 1),
k AS (SELECT doc_id, start, stop, md5(norm) AS digest, count(*) OVER g AS occurrences, first_value(doc_id) OVER o AS kept_doc_id,
  first_value(start) OVER o AS kept_start, row_number() OVER o AS rn
  FROM a WHERE len(string_split(norm, ' ')) >= 8
  WINDOW g AS (PARTITION BY norm), o AS (PARTITION BY norm ORDER BY doc_id, start))
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, digest, occurrences, kept_doc_id, CAST(kept_start AS BIGINT) AS kept_start FROM k WHERE rn > 1
"""


@query
def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.sharding import shard

    return shard(read(spark, sf_dir, "documents"))


@query
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"))


ORACLES["op10_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.linededup import removed_runs

    return removed_runs(read(spark, sf_dir, "documents"), min_words=8)


ORACLES["op9_line_dedup"] = r"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
u AS (SELECT doc_id, t.i AS pos, parts[t.i] AS unit FROM p, unnest(range(1, len(parts) + 1)) AS t(i)),
s AS (SELECT doc_id, pos, unit, length(unit) AS n, sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(unit) - 1 AS start FROM u),
w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line, start, start + n AS stop,
  trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS norm FROM s WHERE trim(regexp_replace(unit, '\s+', ' ', 'g')) <> ''),
c AS (SELECT doc_id, line, norm, greatest(length(norm) - length(replace(norm, ' ', '')) + 1, length(regexp_replace(norm,
  '[^\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}]', '', 'g')) // 2) AS words FROM w),
n AS (SELECT doc_id, line, norm, words, lead(norm, 1) OVER o AS norm1, lead(norm, 2) OVER o AS norm2, lead(words, 1) OVER o AS words1 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
g AS (SELECT doc_id, line, 3 AS lines, norm || chr(10) || norm1 || chr(10) || norm2 AS run FROM n WHERE norm2 IS NOT NULL
  UNION ALL SELECT doc_id, line, 2, norm || chr(10) || norm1 FROM n WHERE words + words1 >= 8
  UNION ALL SELECT doc_id, line, 1, norm FROM n WHERE words >= 8),
k AS (SELECT doc_id, line, lines, row_number() OVER (PARTITION BY run ORDER BY doc_id, line) AS rn FROM g),
d AS (SELECT DISTINCT doc_id, line + j AS line FROM k, unnest([0, 1, 2]) AS t(j) WHERE rn > 1 AND j < lines),
i AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM d)
SELECT i.doc_id, CAST(min(i.line) AS BIGINT) AS line, count(*) AS lines, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop
FROM i JOIN w ON i.doc_id = w.doc_id AND i.line = w.line GROUP BY i.doc_id, island
"""


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.suffix import suffix_dedup

    return suffix_dedup(read(spark, sf_dir, "documents")).drop("spans")


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.bpe import encode, public_vocabulary

    # a document is 4 bytes a token here, so Arrow's batches are kept to fewer of them than by default
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    out = encode(read(spark, sf_dir, "documents"), public_vocabulary(), packed=True, decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.centroids import clusters

    found, centroids = clusters(read(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")
    # k rows, so they may be broadcast
    out = found.join(F.broadcast(centroids.select("cluster", "cluster_inertia", "inertia", digest)), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clustering_sql(rounds: int) -> str:
    parts = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 40))"]
    for i in range(rounds + 1):
        near = f"SELECT v.vec_id, v.x, c, list_dot_product(v.x, v.x) + list_dot_product(k.x, k.x) - 2 * list_dot_product(v.x, k.x) AS d FROM v, c{i} AS k"
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, x, c, d FROM ({near}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if i < rounds:
            mean = f"SELECT c, p, floor(sum(x[p]) / count(*)) AS m FROM a{i}, unnest(range(1, 65)) AS t(p) GROUP BY c, p"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(n.x, k.x) AS x FROM c{i} AS k LEFT JOIN (SELECT c, list(m ORDER BY p) AS x FROM ({mean}) GROUP BY c) AS n ON k.c = n.c)")
    digest = "sha256(array_to_string(list_transform(k.x, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','))"
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  {digest} AS centroid_sha256 FROM a{rounds} AS a JOIN c{rounds} AS k ON a.c = k.c"""


ORACLES["op13_centroid_clustering"] = _clustering_sql(5)


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinspark.llm.conversations import damaged, repair, summary

    return summary(repair(damaged(read(spark, sf_dir, "conversations"))))


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda c, b:
  list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _repair_sql() -> str:
    """Best (cost, audit, text) from each state, row by row from a conversation's end; states: nothing, s, u, a told last."""
    follows, named, before = (2, 2, 3, 2), {2: "user", 3: "assistant"}, {"s": (0,), "u": (0, 1, 3), "a": (2,)}
    lands = {"s": 1, "u": 2, "a": 3}
    best = lambda options: f"list_sort([{', '.join(options)}])[1]"
    row = lambda c, a, t: f"{{'c': {c}, 'a': {a}, 't': {t}}}"
    worst = row("1000000000", "''", "''")
    direct = []
    for s in range(4):
        t = follows[s]
        keep = [f"CASE WHEN sound AND initial = '{i}' THEN {row(f'f{lands[i]}.c + cut', f"""'K' || f{lands[i]}.a""", f"""chr(10) || role || ':' || text || f{lands[i]}.t""")} ELSE {worst} END" for i in before if s in before[i]]
        name = f"CASE WHEN sound THEN {row(f'f{t}.c + 2 + cut', f"""'R' || f{t}.a""", f"""chr(10) || '{named[t]}:' || text || f{t}.t""")} ELSE {worst} END"
        drop = row(f"f{s}.c + 3", f"'D' || f{s}.a", f"f{s}.t")
        direct.append(f"{best([*keep, name, drop])} AS g{s}")
    put = lambda s, n: f"g{s}" if n == 0 else None
    inserted = []
    for s in range(4):
        options, at, told = [put(s, 0)], s, ""
        for n in (1, 2):
            at = follows[at]
            told += f"\n{named[at]}:"
            options.append(row(f"g{at}.c + {2 * n}", f"'{'I' * n}' || g{at}.a", f"'{told}' || g{at}.t"))
        inserted.append(f"{best(options)} AS f{s}")
    base = [row("0", "''", "''"), row("4", "'II'", "'\nuser:\nassistant:'"), row("2", "'I'", "'\nassistant:'"), row("0", "''", "''")]
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {_CRC32} % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') AS ink FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS next FROM o),
r AS (SELECT *, CASE WHEN ink = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM p),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
f AS (SELECT conv_id, n AS i, {', '.join(f'{b} AS f{s}' for s, b in enumerate(base))} FROM n
  UNION ALL SELECT conv_id, i, {', '.join(inserted)} FROM (SELECT f.conv_id, f.i - 1 AS i, {', '.join(direct)}
    FROM f JOIN (SELECT *, fault IN (0, 3) AS sound, CAST(fault = 3 AS INTEGER) AS cut FROM r) AS r ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(f0.c, 0) AS BIGINT) AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(substr(f0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = 0"""


ORACLES["op12_conversation_repair"] = _repair_sql()
