"""Queries of search, joins and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinspark.functions import scalar as S
from twinspark.functions.vector import cosine, normalized, sign_bits
from twinspark.operators import cascade, grouping, similarity
from twinspark.plans.registry import register
from twinspark.sources import tables as T

D, H, V = T.SQL_DESCRIPTORS, T.SQL_HASHES, T.SQL_VIDEOS
DOT = "list_dot_product(a.v, b.v)"
COS = "list_cosine_similarity(a.v, b.v)"


def query_set(spark, sf, every=10):
    return T.descriptors(spark, sf).where(F.col("video_id") % every == 0).select(F.col("video_id").alias("query_id"), "v")


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def grouped_videos(spark, sf):
    return T.descriptors(spark, sf).join(T.videos(spark, sf), "video_id").select("video_id", "v", S.duration_bucket(F.col("duration")).alias("duration_bucket"), S.aspect_class(F.col("width"), F.col("height")).alias("aspect_ratio"))


def _top(score, where="TRUE", k=10, extra="", ids="a.video_id % 10 = 0"):
    return f"WITH {D}{extra}, p AS (SELECT a.video_id AS query_id, b.video_id, {score} AS s FROM desc_ a JOIN desc_ b ON {ids} AND {where}), r AS (SELECT query_id, video_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, video_id) AS rank FROM p) SELECT query_id, video_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"


@register("jn01_topk", _top(DOT))
def jn01(spark, sf):
    return rounded(similarity.topk(query_set(spark, sf), T.descriptors(spark, sf), 10), "score")


_G = f", {V}, meta_ AS (SELECT video_id, {T.SQL_BUCKET} AS db, {T.SQL_ASPECT} AS ar FROM video_)"
_SAME = "EXISTS (SELECT 1 FROM meta_ x JOIN meta_ y ON x.video_id = a.video_id AND y.video_id = b.video_id AND (x.db = 'unknown' OR x.db = y.db) AND (x.ar = 'unknown' OR x.ar = y.ar))"


@register("jn02_filtered_topk", _top(COS, _SAME, extra=_G))
def jn02(spark, sf):
    g = grouped_videos(spark, sf)
    q = g.where("video_id % 10 = 0").withColumnRenamed("video_id", "query_id")
    return rounded(similarity.topk(q, g, 10, "cosine", groups=["duration_bucket", "aspect_ratio"]), "score")


@register("jn03_quantized_topk", f"WITH {D}, {H}, p AS (SELECT a.video_id AS query_id, b.video_id, {COS} AS s, bit_count(xor(x.h, y.h)) AS d FROM desc_ a JOIN desc_ b ON a.video_id % 10 = 0 JOIN hash_ x ON x.video_id = a.video_id JOIN hash_ y ON y.video_id = b.video_id), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, video_id) AS n FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, video_id) AS rank FROM n WHERE n <= 15) SELECT query_id, video_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def jn03(spark, sf):
    return rounded(similarity.quantized_topk(query_set(spark, sf), T.descriptors(spark, sf), 10), "score")


@register("jn04_hamming_pairs", f"WITH {H} SELECT a.video_id AS query_id, b.video_id, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance, round(1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE, 6) AS score FROM hash_ a JOIN hash_ b ON a.video_id < b.video_id AND bit_count(xor(a.h, b.h)) <= 16")
def jn04(spark, sf):
    h = T.hashes(spark, sf)
    return rounded(similarity.hamming_pairs(h, h, 16).where("query_id < video_id"), "score")


@register("jn05_all_pairs", f"WITH {D} SELECT a.video_id AS query_id, b.video_id, round({DOT}, 6) AS score FROM desc_ a JOIN desc_ b ON a.video_id <> b.video_id AND {DOT} >= 0.3")
def jn05(spark, sf):
    d = T.descriptors(spark, sf)
    return rounded(similarity.similar_pairs(d, 0.3).select("query_id", "video_id", "score"), "score")


@register("plb07_collection_topk", _top(COS))
def plb07(spark, sf):
    """The exact answer of a collection with cells: what the nearest cells give, and the cells that may hold better."""
    from twinspark.operators.cells import VectorIndex
    from twinspark.sources.written import place

    d = T.descriptors(spark, sf).select("video_id", "v")
    index = VectorIndex(spark, place(spark, "collection"))
    index.build(d, max(1, d.count() // 64))
    return rounded(index.search(query_set(spark, sf), 10, exact=True), "score")


@register("jn06_lookup", f"WITH {V}, {D}, r AS (SELECT a.video_id AS query_id, b.video_id FROM desc_ a JOIN desc_ b ON a.video_id % 50 = 0 AND b.video_id = a.video_id + 1) SELECT r.query_id, r.video_id, name, duration FROM r LEFT JOIN video_ USING (video_id)")
def jn06(spark, sf):
    hits = query_set(spark, sf, 50).select("query_id", (F.col("query_id") + 1).alias("video_id")).join(T.descriptors(spark, sf), "video_id", "left_semi")
    return hits.join(T.videos(spark, sf).select("video_id", "name", "duration"), "video_id", "left")


@register("jn07_with_features", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def jn07(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", "source").join(T.read(spark, sf, "labels"), "doc_id", "left_semi")


@register("jn08_resume", f"WITH {T.SQL_FILES}, f AS (SELECT path, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), '_[^_]*$', '') AS source_stem FROM file_) SELECT path, source_stem FROM f WHERE source_stem NOT IN (SELECT source_stem FROM f WHERE right(source_stem, 1) = '3')")
def jn08(spark, sf):
    f = T.files(spark, sf).select("path", S.without_token(S.stem(F.col("path"))).alias("source_stem"))
    done = f.where(F.col("source_stem").endswith("3")).select("source_stem").distinct()
    return f.join(done, "source_stem", "left_anti")


@register("jn09_merge_candidates", f"WITH {D}, {H}, p AS (SELECT a.video_id AS query_id, b.video_id, {COS} AS s FROM desc_ a JOIN desc_ b ON a.video_id % 10 = 0 AND {COS} >= 0.3), m AS (SELECT a.video_id AS query_id, b.video_id, 1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE AS s FROM hash_ a JOIN hash_ b ON a.video_id % 10 = 0 AND bit_count(xor(a.h, b.h)) <= 20) SELECT query_id, video_id, round(s, 6) AS score, 0 AS late FROM p UNION ALL SELECT query_id, video_id, round(s, 6), 1 FROM m WHERE (query_id, video_id) NOT IN (SELECT (query_id, video_id) FROM p)")
def jn09(spark, sf):
    d, h = T.descriptors(spark, sf), T.hashes(spark, sf)
    cand = similarity.topk(query_set(spark, sf), d, None, "cosine", threshold=0.3).select("query_id", "video_id", "score", F.lit(0).alias("late"))
    m = similarity.hamming_pairs(h.where("video_id % 10 = 0"), h, 20).select("query_id", "video_id", "score", F.lit(1).alias("late"))
    return rounded(cand.unionByName(m.join(cand.select("query_id", "video_id"), ["query_id", "video_id"], "left_anti")), "score")


@register("jn10_prepended_merge", "WITH c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE doc_id % 3 > 0), h AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn FROM documents WHERE doc_id % 3 < 2 AND doc_id % 3 = 0), u AS (SELECT source, doc_id, -rn AS k FROM h UNION ALL SELECT source, doc_id, rn FROM c) SELECT source, doc_id, CAST(k AS INTEGER) AS place FROM u")
def jn10(spark, sf):
    from twinspark.operators.metrics import ranks_within

    # a source stands for a query, and may hold most documents: two thirds of its documents are candidates, two thirds new hits, some of them candidates
    d = T.read(spark, sf, "documents").select("source", "doc_id", "n_chars")
    cand = ranks_within(d.where("doc_id % 3 > 0"), "source", [F.desc("n_chars"), F.col("doc_id")])
    hits = d.where("doc_id % 3 < 2").join(cand.select("source", "doc_id"), ["source", "doc_id"], "left_anti")
    new = ranks_within(hits, "source", [F.col("n_chars"), F.col("doc_id")]).withColumn("place", -F.col("place"))
    return cand.unionByName(new).select("source", "doc_id", F.col("place").cast("int").alias("place"))


@register("jn12_cross_scores", f"WITH {D} SELECT a.video_id AS query_id, b.video_id, round({DOT}, 6) AS score FROM desc_ a JOIN desc_ b ON a.video_id % 50 = 0")
def jn12(spark, sf):
    return rounded(similarity.scores(query_set(spark, sf, 50), T.descriptors(spark, sf)), "score")


@register("jn13_ground_truth", f"WITH {D} SELECT a.video_id AS query_id, b.video_id FROM desc_ a JOIN desc_ b USING (label) WHERE a.video_id % 10 = 0 AND a.video_id <> b.video_id AND b.video_id % 3 <> 0")
def jn13(spark, sf):
    d = T.descriptors(spark, sf).drop("v")
    q = d.where("video_id % 10 = 0").withColumnRenamed("video_id", "query_id")
    known = d.where("video_id % 3 <> 0").select("video_id")
    return q.join(d, "label").join(known, "video_id", "left_semi").where("query_id <> video_id").select("query_id", "video_id")


@register("jn14_query_event", "SELECT e.event_id, event_type, r_name FROM events e JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) n ON e.user_id % 25 = n.n_nationkey")
def jn14(spark, sf):
    n = T.read(spark, sf, "nation").join(T.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    e = T.read(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 25).alias("n_nationkey"))
    return e.join(n, "n_nationkey").select("event_id", "event_type", "r_name")


@register("jn15_dense_rows", f"WITH {D} SELECT a.video_id AS query_id, b.video_id, round({DOT}, 6) AS score FROM desc_ a JOIN desc_ b ON a.video_id % 100 = 0")
def jn15(spark, sf):
    """Rows of scores without ids, in the order of the database, get the ids of the sorted database, a tile of it at a time."""
    from twinspark.operators.metrics import running_ranks
    from twinspark.sources.written import materialize

    d = running_ranks(T.descriptors(spark, sf).select("video_id", "v", F.lit(1).alias("one")), [F.col("video_id")], "one")
    items = F.sort_array(F.collect_list(F.struct("rn", F.struct("video_id", "v").alias("item"))))
    tiled = d.groupBy(F.floor((F.col("rn") - 1) / 4096).alias("tile")).agg(F.transform(items, lambda x: x["item"]).alias("items"))
    tiled = materialize(tiled, "tiles")
    ids = materialize(tiled.select("tile", F.col("items.video_id").alias("ids")), "ids")
    dense = similarity.dense_rows(query_set(spark, sf, 100), tiled)
    return rounded(dense.join(ids, "tile").select("query_id", F.explode(F.arrays_zip(F.col("ids").alias("video_id"), F.col("row").alias("score"))).alias("c")).select("query_id", "c.video_id", "c.score"), "score")


@register("prj19_frame_hash_match", f"WITH {H}, f AS (SELECT CAST(floor(video_id / 10) AS BIGINT) AS video_id, video_id % 10 AS frame_idx, h FROM hash_), m AS (SELECT DISTINCT a.video_id AS query_id, b.video_id, a.frame_idx FROM f a JOIN f b ON a.video_id < b.video_id AND bit_count(xor(a.h, b.h)) <= 20) SELECT query_id, video_id, round(count(*) / 10.0::DOUBLE, 6) AS score FROM m GROUP BY ALL HAVING count(*) >= 2")
def prj19(spark, sf):
    h = T.hashes(spark, sf).select(F.floor(F.col("video_id") / 10).alias("video_id"), (F.col("video_id") % 10).alias("frame_idx"), "h")
    return rounded(similarity.frame_hash_matches(h, h, 20, 0.2).where("query_id < video_id"), "score")


_WORDS = "[xor(h, CAST((1 << n0) - 1 AS UBIGINT)), xor(xor(h, 18446744073709551615::UBIGINT), CAST((1 << n1) - 1 AS UBIGINT)), xor(h, CAST((1 << n2) - 1 AS UBIGINT)), xor(xor(h, 18446744073709551615::UBIGINT), CAST((1 << n3) - 1 AS UBIGINT))]"
_FLIPS = ", ".join(f"video_id % 40 // 4 + CAST({k} < video_id % 40 % 4 AS INT) AS n{k}" for k in range(4))


@register("plb04_frame_hash_share", f"WITH {H}, o AS (SELECT CAST(floor(video_id / 10) AS BIGINT) AS video, video_id % 10 AS frame_idx, h, {_FLIPS} FROM hash_), a AS (SELECT video, frame_idx, [h, xor(h, 18446744073709551615::UBIGINT), h, xor(h, 18446744073709551615::UBIGINT)] AS w FROM o), b AS (SELECT video, frame_idx, {_WORDS} AS w FROM o), m AS (SELECT DISTINCT a.video AS query_id, b.video AS video_id, a.frame_idx FROM a JOIN b ON list_sum(list_transform(range(1, 5), lambda i: bit_count(xor(a.w[i], b.w[i])))) <= 31), t AS (SELECT video AS query_id, count(*) AS n FROM a GROUP BY video) SELECT query_id, video_id, round(count(*) / any_value(n)::DOUBLE, 6) AS score FROM m JOIN t USING (query_id) GROUP BY ALL HAVING count(*) / any_value(n)::DOUBLE >= 0.3")
def plb04(spark, sf):
    """Frames with hashes of four words; the other side's are damaged by up to 39 bits, as their id says."""
    id_, video = F.col("video_id"), F.floor(F.col("video_id") / 10)
    word = lambda k: F.col("h") if k % 2 == 0 else F.bitwise_not("h")
    mask = lambda k: F.expr(f"shiftleft(1L, CAST(video_id % 40 div 4 + IF({k} < video_id % 40 % 4, 1, 0) AS INT)) - 1")
    h = T.hashes(spark, sf)
    frames = lambda words: h.select(video.alias("video_id"), (id_ % 10).alias("frame_idx"), F.array(*words).alias("h"))
    damaged = frames([word(k).bitwiseXOR(mask(k)) for k in range(4)])
    return rounded(similarity.frame_hash_matches(frames([word(k) for k in range(4)]), damaged, 31, 0.3, 256), "score")


@register("p2_cascade")
def p2(spark, sf):
    from twinspark.functions.vector import doubles

    e = T.read(spark, sf, "embeddings")
    frames = e.select(F.col("vec_id").alias("video_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice(doubles(F.col("embedding")), r * 16 + 1, F.lit(16)))).alias("frame_idx", "f"))
    g, h = grouped_videos(spark, sf), T.hashes(spark, sf)
    q = g.where("video_id % 20 = 0").withColumnRenamed("video_id", "query_id")
    return cascade.search(q, g, h, h.where("video_id % 20 = 0"), frames, cascade.SearchOptions(threshold=0.5, max_distance=16), ["duration_bucket", "aspect_ratio"])


_EDGES = f"WITH RECURSIVE {D}, e AS (SELECT a.video_id AS u, b.video_id AS v FROM desc_ a JOIN desc_ b ON a.video_id <> b.video_id AND {DOT} >= 0.4)"


@register("agg17_components", f"{_EDGES}, r AS (SELECT u AS x, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.x) SELECT x AS video_id, min(c) AS component FROM r GROUP BY x")
def agg17c(spark, sf):
    return grouping.components(similarity.similar_pairs(T.descriptors(spark, sf), 0.4))


@register("agg17_greedy_groups")
def agg17(spark, sf):
    return grouping.greedy_groups(similarity.similar_pairs(T.descriptors(spark, sf), 0.4, k=50))


@register("agg18_component_report", f"{_EDGES}, r AS (SELECT u AS x, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.x), g AS (SELECT x, min(c) AS c FROM r GROUP BY x) SELECT count(DISTINCT c) AS num_groups, count(*) - count(DISTINCT c) AS num_duplicates FROM g")
def agg18(spark, sf):
    c = grouping.components(similarity.similar_pairs(T.descriptors(spark, sf), 0.4))
    return grouping.report(c.withColumnRenamed("component", "group_id"))


@register("snk08_batch_report")
def snk08(spark, sf):
    return grouping.report(grouping.greedy_groups(similarity.similar_pairs(T.descriptors(spark, sf), 0.4, k=50)))


@register("prj01_duration_bucket", f"WITH {V} SELECT video_id, duration, {T.SQL_BUCKET} AS bucket FROM video_")
def prj01(spark, sf):
    return T.videos(spark, sf).select("video_id", "duration", S.duration_bucket(F.col("duration")).alias("bucket"))


@register("prj02_aspect_class", f"WITH {V} SELECT video_id, {T.SQL_ASPECT} AS aspect FROM video_")
def prj02(spark, sf):
    return T.videos(spark, sf).select("video_id", S.aspect_class(F.col("width"), F.col("height")).alias("aspect"))


@register("prj03_hash_text", f"WITH {H} SELECT video_id, printf('%x', h) AS phash FROM hash_")
def prj03(spark, sf):
    return T.hashes(spark, sf).select("video_id", S.hash_text(F.col("h")).alias("phash"))


@register("prj04_hash_number", "SELECT doc_id, CAST(('0x' || left(md5(text), 12)) AS BIGINT) AS h FROM documents")
def prj04(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", S.hash_number(F.substring(F.md5("text"), 1, 12)).alias("h"))


@register("prj05_hamming_score", f"WITH {H} SELECT a.video_id, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance, round(1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE, 6) AS score FROM hash_ a JOIN hash_ b ON b.video_id = a.video_id + 1")
def prj05(spark, sf):
    h = T.hashes(spark, sf)
    j = h.join(h.select((F.col("video_id") - 1).alias("video_id"), F.col("h").alias("g")), "video_id")
    return rounded(j.select("video_id", S.hamming(F.col("h"), F.col("g")).alias("distance"), S.hamming_score(F.col("h"), F.col("g")).alias("score")), "score")


@register("prj07_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def prj07(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"))


@register("prj08_normalize", f"WITH {D} SELECT video_id, round(list_transform(v, lambda x: 3 * x)[1] / (3 * sqrt(list_dot_product(v, v))), 6) AS first, round(list_aggregate(v, 'sum') / sqrt(list_dot_product(v, v)), 6) AS total FROM desc_")
def prj08(spark, sf):
    n = normalized(F.transform("v", lambda x: x * 3))
    d = T.descriptors(spark, sf).select("video_id", n.alias("n"))
    return rounded(d.select("video_id", F.col("n")[0].alias("first"), F.aggregate("n", F.lit(0.0), lambda s, x: s + x).alias("total")), "first", "total")


@register("prj13_binary_similarity", f"WITH {D}, s AS (SELECT video_id, list_transform(v, lambda x: sign(x)::DOUBLE) AS v FROM desc_) SELECT a.video_id, round({DOT} / 64, 6) AS score FROM s a JOIN s b ON b.video_id = a.video_id + 1")
def prj13(spark, sf):
    d = T.descriptors(spark, sf).select("video_id", F.transform("v", F.signum).alias("v"))
    j = d.join(d.select((F.col("video_id") - 1).alias("video_id"), F.col("v").alias("w")), "video_id")
    from twinspark.functions.vector import dot

    return rounded(j.select("video_id", (dot(F.col("v"), F.col("w")) / F.size("v")).alias("score")), "score")


@register("prj14_similarity_normalize", f"WITH {D} SELECT a.video_id, round(greatest(-1, least(1, 5 * {DOT})) / 2 + 0.5, 6) AS score FROM desc_ a JOIN desc_ b ON b.video_id = a.video_id + 1")
def prj14(spark, sf):
    from twinspark.functions.vector import dot

    d = T.descriptors(spark, sf)
    j = d.join(d.select((F.col("video_id") - 1).alias("video_id"), F.col("v").alias("w")), "video_id")
    return rounded(j.select("video_id", S.similarity_normalized(5 * dot(F.col("v"), F.col("w"))).alias("score")), "score")


@register("prj16_metadata_filter", f"WITH {V}, m AS (SELECT video_id, {T.SQL_BUCKET} AS db, {T.SQL_ASPECT} AS ar FROM video_) SELECT video_id FROM m WHERE db = '1-5m' AND ar = 'landscape'")
def prj16(spark, sf):
    v = T.videos(spark, sf)
    return v.where((S.duration_bucket(F.col("duration")) == "1-5m") & (S.aspect_class(F.col("width"), F.col("height")) == "landscape")).select("video_id")


@register("prj17_score_threshold", f"WITH {D} SELECT a.video_id AS query_id, b.video_id, round({DOT}, 6) AS score FROM desc_ a JOIN desc_ b ON a.video_id % 10 = 0 AND {DOT} >= 0.25")
def prj17(spark, sf):
    return rounded(similarity.topk(query_set(spark, sf), T.descriptors(spark, sf), None, threshold=0.25).drop("rank"), "score")


@register("prj18_pre_threshold", f"WITH {D}, p AS (SELECT a.video_id AS query_id, b.video_id, {DOT} AS s FROM desc_ a JOIN desc_ b ON a.video_id % 10 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, video_id) AS rank FROM p) SELECT query_id, video_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50 AND s >= 0.5 * 0.5")
def prj18(spark, sf):
    return rounded(similarity.topk(query_set(spark, sf), T.descriptors(spark, sf), 50).where("score >= 0.5 * 0.5D"), "score")


@register("prj21_has_thumbnail", "SELECT d.doc_id, l.doc_id IS NOT NULL AS has_thumbnail FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def prj21(spark, sf):
    lab = T.read(spark, sf, "labels").select("doc_id", F.lit(True).alias("t"))
    return T.read(spark, sf, "documents").select("doc_id").join(lab, "doc_id", "left").select("doc_id", F.col("t").isNotNull().alias("has_thumbnail"))


@register("prj22_id_filter", f"WITH {T.SQL_FILES} SELECT path FROM file_ WHERE contains(lower(path), 'clip_1')")
def prj22(spark, sf):
    return T.files(spark, sf).where(F.lower("path").contains("clip_1")).select("path")


@register("prj23_score_class", "SELECT event_id, CASE WHEN value / 500 >= 0.95 THEN 'high' WHEN value / 500 >= 0.85 THEN 'medium' ELSE 'low' END AS class FROM events")
def prj23(spark, sf):
    return T.read(spark, sf, "events").select("event_id", S.score_class(F.col("value") / 500).alias("class"))


@register("prj24_clock", "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock FROM (SELECT event_id, CAST(floor(value * 20) AS BIGINT) AS s FROM events)")
def prj24(spark, sf):
    return T.read(spark, sf, "events").select("event_id", S.clock(F.col("value") * 20).alias("clock"))


@register("prj25_stem", f"WITH {T.SQL_FILES} SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM file_")
def prj25(spark, sf):
    return T.files(spark, sf).select("path", S.stem(F.col("path")).alias("stem"))


@register("src02_discover", f"WITH {T.SQL_FILES}, k AS (SELECT *, row_number() OVER (PARTITION BY real_path ORDER BY path) AS rn FROM file_ WHERE length > 0 AND NOT contains(path, '/.') AND lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) IN ('mp4', 'mkv', 'avi', 'mov', 'webm')) SELECT path, real_path, length FROM k WHERE rn = 1")
def src02(spark, sf):
    from twinspark.sources.files import distinct_media

    return distinct_media(T.files(spark, sf))


@register("src03_probe", "SELECT event_id, round(CAST(value * 1000 AS BIGINT) / CAST(greatest(user_id % 3 * 500, 1) AS DOUBLE), 2) AS fps FROM events")
def src03(spark, sf):
    e = T.read(spark, sf, "events")
    return e.select("event_id", S.fraction(F.concat(F.round(F.col("value") * 1000).cast("long").cast("string"), F.lit("/"), (F.col("user_id") % 3 * 500).cast("string"))).alias("fps"))


@register("src17_valid_hashes", "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN left(md5(text), 13) WHEN doc_id % 3 = 1 THEN 'zz' || doc_id ELSE NULL END AS raw FROM documents) SELECT doc_id, CAST('0x' || raw AS BIGINT) AS h FROM s WHERE regexp_full_match(raw, '[0-9a-fA-F]{1,16}')")
def src17(spark, sf):
    d = T.read(spark, sf, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.substring(F.md5("text"), 1, 13)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("zz"), F.col("doc_id").cast("string")))
    return d.select("doc_id", raw.alias("raw")).where(S.is_hash_text(F.col("raw"))).select("doc_id", S.hash_number(F.col("raw")).alias("h"))


@register("snk07_result_json", _top(COS, k=1, ids="a.video_id % 50 = 0 AND a.video_id <> b.video_id").replace("SELECT query_id, video_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank", "SELECT '{\"video_id\":' || video_id || ',\"score\":' || round(s, 4) || ',\"path\":\"/v/' || query_id || '.mp4\"}' AS line"))
def snk07(spark, sf):
    t = similarity.topk(query_set(spark, sf, 50), T.descriptors(spark, sf), 1, "cosine", exclude_self=True)
    from twinspark.operators.engine import results_json

    return results_json(t.withColumn("path", F.concat(F.lit("/v/"), F.col("query_id").cast("string"), F.lit(".mp4"))))


@register("sign_bits", f"WITH {H} SELECT video_id, CAST(bit_count(h) AS INTEGER) AS ones FROM hash_")
def signs(spark, sf):
    return T.descriptors(spark, sf).select("video_id", F.bit_count(sign_bits(F.col("v"))).alias("ones"))


@register("jn02_cosine_pairs", f"WITH {D} SELECT a.video_id, round({COS}, 6) AS score FROM desc_ a JOIN desc_ b ON b.video_id = a.video_id + 1")
def cos(spark, sf):
    d = T.descriptors(spark, sf)
    j = d.join(d.select((F.col("video_id") - 1).alias("video_id"), F.col("v").alias("w")), "video_id")
    return rounded(j.select("video_id", cosine(F.col("v"), F.col("w")).alias("score")), "score")




@register("win03_topk_partners", _top(COS, k=20, ids="TRUE").replace("SELECT query_id, video_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank", "SELECT query_id, video_id, round(s, 6) AS score").replace("rank <= 20", "rank <= 20 AND s >= 0.3 AND query_id <> video_id"))
def win03(spark, sf):
    return rounded(similarity.similar_pairs(T.descriptors(spark, sf), 0.3, "cosine", k=20).drop("rank"), "score")


@register("snk01_written_and_read", f"WITH {V} SELECT video_id, duration, {T.SQL_BUCKET} AS bucket FROM video_ WHERE {T.SQL_BUCKET} = '10-30s'")
def snk01(spark, sf):
    """What a table partitioned by bucket gives back of one partition."""
    from twinspark.sources.written import shared_dir

    path = f"{shared_dir(spark).rstrip('/')}/videos-{spark.sparkContext.applicationId}"
    v = T.videos(spark, sf).select("video_id", "duration", S.duration_bucket(F.col("duration")).alias("bucket"))
    v.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return spark.read.schema("video_id long, duration double, bucket string").parquet(path).where("bucket = '10-30s'")


@register("str01_arrivals", f"WITH {V} SELECT video_id, max(duration) AS duration FROM video_ GROUP BY video_id")
def str01(spark, sf):
    """What ingest does with two micro-batches, the second one twice: the newest row of each id."""
    from twinspark.operators.catalog import VideoTable
    from twinspark.sources.written import place

    rows = T.videos(spark, sf).select("video_id", "duration", F.col("ts").cast("timestamp").alias("ts"))
    table = VideoTable(spark, place(spark, "str01"), "video_id bigint, duration double, ts timestamp", ())
    for number in (0, 1, 1):
        table.newest(rows.where(F.pmod(F.xxhash64("video_id", "ts"), F.lit(2)) == number), "ts", number)
    return table.current().drop("ts")


@register("mut10_listing", f"WITH {V}, m AS (SELECT video_id, name, {T.SQL_BUCKET} AS duration_bucket, {T.SQL_ASPECT} AS aspect_ratio, printf('%x', (SELECT 15)) AS phash FROM video_) SELECT * FROM m ORDER BY video_id LIMIT 100")
def mut10(spark, sf):
    v = T.videos(spark, sf)
    m = v.select("video_id", "name", S.duration_bucket(F.col("duration")).alias("duration_bucket"), S.aspect_class(F.col("width"), F.col("height")).alias("aspect_ratio"), S.hash_text(F.lit(15).cast("long")).alias("phash"))
    from twinspark.operators.catalog import page_after

    return page_after(m, None, 100)
