"""Queries on frame sequences and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinspark.operators import temporal as O
from twinspark.plans.registry import register
from twinspark.plans.search import rounded
from twinspark.sources import tables as T

#: Lines of documents as frames of videos.
FRAMES = "f_ AS (SELECT doc_id AS video_id, i - 1 AS frame_idx, md5(parts[i]) AS f FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS t(i)), n_ AS (SELECT video_id, count(*) AS n FROM f_ GROUP BY video_id)"


def frames(spark, sf):
    d = T.read(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("frame_idx", "t")).select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.md5("t").alias("f"))


@register("tmp01_padded", f"WITH {FRAMES} SELECT f_.video_id, CAST(frame_idx + c * n AS BIGINT) AS frame_idx, f FROM f_ JOIN n_ USING (video_id), unnest(range(CAST(2 ** greatest(0, ceil(log2(4.0 / n))) AS INTEGER))) AS t(c)")
def tmp01(spark, sf):
    return O.padded(frames(spark, sf))


@register("src11_padding_plan", f"WITH {FRAMES} SELECT video_id, n, CAST(2 ** greatest(0, ceil(log2(4.0 / n))) AS INTEGER) AS least, CAST(2 ** greatest(0, floor(log2(4.0 / n)) + 1) AS INTEGER) AS more FROM n_")
def src11(spark, sf):
    n = frames(spark, sf).groupBy("video_id").agg(F.count("*").alias("n"))
    return n.select("video_id", "n", O.copies(F.col("n"), 4).alias("least"), O.copies(F.col("n"), 4, True).alias("more"))


@register("tmp02_crop", f"WITH {FRAMES} SELECT video_id, frame_idx - video_id % 3 AS frame_idx, f FROM f_ WHERE frame_idx >= video_id % 3 AND frame_idx < video_id % 3 + 4")
def tmp02(spark, sf):
    return O.cropped(frames(spark, sf), F.col("video_id") % 3, 4)


@register("tmp03_fast_forward", f"WITH {FRAMES} SELECT video_id, frame_idx // 3 AS frame_idx, f FROM f_ WHERE frame_idx % 3 = 0")
def tmp03(spark, sf):
    return O.fast_forward(frames(spark, sf), 3)


@register("tmp04_slow_motion", f"WITH {FRAMES} SELECT video_id, frame_idx * 2 + r AS frame_idx, f FROM f_, unnest(range(2)) AS t(r)")
def tmp04(spark, sf):
    return O.slow_motion(frames(spark, sf))


@register("tmp05_reverse", f"WITH {FRAMES} SELECT video_id, n - 1 - frame_idx AS frame_idx, f FROM f_ JOIN n_ USING (video_id)")
def tmp05(spark, sf):
    return O.reversed_frames(frames(spark, sf))


@register("tmp06_pause", f"WITH {FRAMES} SELECT video_id, frame_idx + s AS frame_idx, f FROM f_, unnest(CASE WHEN frame_idx = 2 THEN [0, 1, 2, 3] WHEN frame_idx > 2 THEN [3] ELSE [0] END) AS t(s)")
def tmp06(spark, sf):
    return O.paused(frames(spark, sf), 2, 3)


@register("tmp07_shuffle_windows", f"WITH {FRAMES}, w AS (SELECT f_.*, frame_idx // 4 AS w FROM f_ JOIN n_ USING (video_id) WHERE frame_idx // 4 < n // 4), p AS (SELECT video_id, w, row_number() OVER (PARTITION BY video_id ORDER BY md5('7|' || video_id || '|' || w), w) - 1 AS place FROM (SELECT DISTINCT video_id, w FROM w)) SELECT video_id, place * 4 + frame_idx % 4 AS frame_idx, f FROM w JOIN p USING (video_id, w)")
def tmp07(spark, sf):
    return O.windows_shuffled(frames(spark, sf), 4, 7)


@register("tmp07_drop_windows", f"WITH {FRAMES}, w AS (SELECT *, (video_id + frame_idx // 4) % 3 = 0 AS d FROM f_), a AS (SELECT *, bool_and(d) OVER (PARTITION BY video_id) AS every FROM w) SELECT video_id, frame_idx, f FROM a WHERE NOT d OR every")
def tmp07d(spark, sf):
    return O.windows_dropped(frames(spark, sf), 4, (F.col("video_id") + F.col("w")) % 3 == 0)


_U = "CAST(('0x' || left(md5('3|' || doc_id), 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@register("tmp08_pick", f"SELECT doc_id, CASE WHEN {_U} < 0.2 THEN 'reverse' WHEN {_U} < 0.5 THEN 'pause' ELSE 'none' END AS pick FROM documents")
def tmp08(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", O.pick(O.hashed_uniform("doc_id", seed=3), {"reverse": 2, "pause": 3, "none": 5}).alias("pick"))


@register("tmp10_mixed_labels", "SELECT a.vec_id AS i, b.vec_id AS j, CASE WHEN a.vec_id = b.vec_id THEN 1.0::DOUBLE WHEN b.vec_id = a.vec_id // 60 * 60 + (a.vec_id + 7) % 60 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id // 60 = b.vec_id // 60")
def tmp10(spark, sf):
    """In batches of 60."""
    e = T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.struct(F.expr("vec_id div 60").alias("batch"), "label").alias("label"))
    donors = e.select("i", F.expr("i div 60 * 60 + (i + 7) % 60").alias("j"), F.lit(0.3).alias("mix"))
    return O.label_matrix(e).join(donors, ["i", "j"], "left").select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.coalesce("mix", F.lit(0.0))).alias("y"))


_BOX = "SELECT event_id, user_id % 50 AS x0, user_id % 30 AS y0, user_id % 50 + 40 AS x1, user_id % 30 + 25 AS y1, event_id % 60 AS u0, event_id % 40 AS v0, event_id % 60 + 30 AS u1, event_id % 40 + 30 AS v1 FROM events"


@register("tmp11_box_intersection", f"SELECT event_id, greatest(0, least(x1, u1) - greatest(x0, u0)) * greatest(0, least(y1, v1) - greatest(y0, v0)) AS area FROM ({_BOX})")
def tmp11(spark, sf):
    e = T.read(spark, sf, "events").selectExpr("event_id", "user_id % 50 x0", "user_id % 30 y0", "user_id % 50 + 40 x1", "user_id % 30 + 25 y1", "event_id % 60 u0", "event_id % 40 v0", "event_id % 60 + 30 u1", "event_id % 40 + 30 v1")
    return e.select("event_id", O.box_intersection(("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1")).alias("area"))


@register("tmp13_weighted_choice", f"SELECT doc_id, CASE WHEN {_U.replace('3|', '5|')} < 0.1 THEN 'a' WHEN {_U.replace('3|', '5|')} < 0.4 THEN 'b' ELSE 'c' END AS choice, CAST(floor({_U.replace('3|', '6|')} * 10) AS BIGINT) AS k FROM documents")
def tmp13(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", O.pick(O.hashed_uniform("doc_id", seed=5), {"a": 0.1, "b": 0.3, "c": 0.6}).alias("choice"), F.floor(O.hashed_uniform("doc_id", seed=6) * 10).alias("k"))


@register("tmp14_label_matrix", "SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id // 100 = b.vec_id // 100")
def tmp14(spark, sf):
    """In batches of 100."""
    return O.label_matrix(T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.struct(F.expr("vec_id div 100").alias("batch"), "label").alias("label")))


@register("tmp15_collated_mask", f"WITH {FRAMES}, m_ AS (SELECT video_id, max(n) OVER (PARTITION BY video_id // 8) AS m FROM n_), g AS (SELECT video_id, i AS frame_idx FROM m_, unnest(range(m)) AS t(i)) SELECT g.video_id, CAST(g.frame_idx AS BIGINT) AS frame_idx, CAST(f IS NOT NULL AS INTEGER) AS mask FROM g LEFT JOIN f_ USING (video_id, frame_idx)")
def tmp15(spark, sf):
    """In batches of 8 videos, padded to the longest of each."""
    from pyspark.sql import Window

    f = frames(spark, sf)
    most = F.max("n").over(Window.partitionBy(F.expr("video_id div 8")))
    sizes = f.groupBy("video_id").agg(F.count("*").alias("n")).select("video_id", most.alias("m"))
    grid = sizes.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("frame_idx"))
    return grid.join(f, ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", F.col("f").isNotNull().cast("int").alias("mask"))


@register("tmp16_batches", f"WITH {FRAMES} SELECT video_id, frame_idx // 8 AS batch, count(*) AS n FROM f_ GROUP BY ALL")
def tmp16(spark, sf):
    return frames(spark, sf).groupBy("video_id", F.expr("frame_idx div 8").alias("batch")).agg(F.count("*").alias("n"))


@register("win05_subsample", f"WITH {FRAMES} SELECT f_.video_id, CAST(k AS BIGINT) AS frame_idx, f FROM n_, unnest(range(least(n, 10))) AS t(k) JOIN f_ ON f_.video_id = n_.video_id AND f_.frame_idx = CASE WHEN n <= 10 THEN k ELSE k * (n - 1) // 9 END")
def win05(spark, sf):
    return O.subsampled(frames(spark, sf), 10).withColumn("frame_idx", F.col("frame_idx").cast("long"))


@register("src06_frame_sampling", f"WITH {FRAMES} SELECT video_id, frame_idx FROM f_ WHERE frame_idx % CAST(greatest(round(CASE WHEN video_id % 200 > 144 THEN 25.0 ELSE (video_id % 200)::DOUBLE END / 10), 1) AS BIGINT) = 0")
def src06(spark, sf):
    return O.sampled_frames(frames(spark, sf), (F.col("video_id") % 200).cast("double"), 10).select("video_id", "frame_idx")


@register("src08_frame_count", f"WITH {FRAMES} SELECT video_id, n FROM n_")
def src08(spark, sf):
    return frames(spark, sf).groupBy("video_id").agg(F.count("*").alias("n"))


@register("src10_feature_slice", f"WITH {FRAMES} SELECT video_id, frame_idx, f FROM f_ WHERE video_id = 42 AND frame_idx BETWEEN 1 AND 3")
def src10(spark, sf):
    return frames(spark, sf).where("video_id = 42 and frame_idx between 1 and 3")


@register("prj20_crop_box", "SELECT event_id, (40 + user_id % 40 * 8 - 32) // 2 AS x, (40 + event_id % 40 * 4 - 24) // 2 AS y FROM events")
def prj20(spark, sf):
    from twinspark.operators.models import crop_offset

    x, y = crop_offset(40 + F.col("user_id") % 40 * 8, 32), crop_offset(40 + F.col("event_id") % 40 * 4, 24)
    return T.read(spark, sf, "events").select("event_id", x.alias("x"), y.alias("y"))


@register("agg21_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS avg5 FROM events")
def agg21(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return rounded(T.read(spark, sf, "events").select("event_id", F.avg("value").over(w).alias("avg5")), "avg5")


@register("str03_progress_counts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def str03(spark, sf):
    """The batch form of the streaming count; tests run the same plan as a stream."""
    from twinspark.streaming.ingest import progress

    e = T.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return progress(e).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@register("str05_stream_static_match", f"WITH {T.SQL_HASHES}, q AS (SELECT video_id AS query_id, h FROM hash_ WHERE video_id % 3 = 0) SELECT query_id, video_id FROM q JOIN hash_ USING (h)")
def str05(spark, sf):
    from twinspark.streaming.ingest import matched

    h = T.hashes(spark, sf)
    return matched(h.where("video_id % 3 = 0").withColumnRenamed("video_id", "query_id"), h).select("query_id", "video_id")


@register("src09_random_window", f"WITH {FRAMES}, s AS (SELECT video_id, n, CAST(floor(CAST(('0x' || left(md5('9|' || video_id), 8)) AS BIGINT) / 4294967296.0::DOUBLE * (greatest(n - 4, 0) + 1)) AS BIGINT) AS start FROM n_) SELECT f_.video_id, frame_idx - start AS frame_idx, f FROM f_ JOIN s USING (video_id) WHERE frame_idx >= start AND frame_idx < start + 4")
def src09(spark, sf):
    f = frames(spark, sf)
    n = f.groupBy("video_id").agg(F.count("*").alias("n"))
    start = F.floor(O.hashed_uniform("video_id", seed=9) * (F.greatest(F.col("n") - 4, F.lit(0)) + 1))
    return O.cropped(f.join(n, "video_id").withColumn("start", start), F.col("start"), 4).select("video_id", "frame_idx", "f")


@register("snk10_thumbnail_frame", f"WITH {FRAMES} SELECT f_.video_id, frame_idx, f FROM f_ JOIN n_ USING (video_id) WHERE frame_idx = CAST(floor(0.1 * n) AS BIGINT)")
def snk10(spark, sf):
    f = frames(spark, sf)
    n = f.groupBy("video_id").agg(F.floor(0.1 * F.count("*")).alias("frame_idx"))
    return f.join(n, ["video_id", "frame_idx"]).select("video_id", "frame_idx", "f")


@register("plb22_shuffled_order", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('1|' || doc_id), doc_id) AS place FROM documents")
def plb22(spark, sf):
    from twinspark.operators.metrics import ranks_within

    d = T.read(spark, sf, "documents").select("doc_id", "lang", F.md5(F.concat_ws("|", F.lit("1"), "doc_id")).alias("draw"))
    return ranks_within(d, "lang", [F.col("draw"), F.col("doc_id")]).select("doc_id", "place")


@register("tmp09_strong_pipeline", f"WITH {FRAMES}, c AS (SELECT video_id, frame_idx - video_id % 2 AS frame_idx, f FROM f_ WHERE frame_idx >= video_id % 2 AND frame_idx < video_id % 2 + 8), s AS (SELECT video_id, frame_idx // 2 AS frame_idx, f FROM c WHERE frame_idx % 2 = 0), m AS (SELECT video_id, max(frame_idx) AS last FROM s GROUP BY video_id) SELECT video_id, last - frame_idx AS frame_idx, f FROM s JOIN m USING (video_id)")
def tmp09(spark, sf):
    return O.reversed_frames(O.fast_forward(O.cropped(frames(spark, sf), F.col("video_id") % 2, 8), 2))


@register("str02_first_within", "WITH k AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id FROM k WHERE before IS NULL OR ts - before > INTERVAL 12 HOUR")
def str02(spark, sf):
    """The batch form of dropping keys seen within a time to live, where each sighting renews it."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = T.read(spark, sf, "events").withColumn("before", F.lag("ts").over(w))
    return e.where(F.col("before").isNull() | (F.col("ts") - F.col("before") > F.expr("interval 12 hours"))).select("event_id", "user_id")


@register("str04_newest_of_key", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 5")
def str04(spark, sf):
    from twinspark.streaming.ingest import newest

    return newest(T.read(spark, sf, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 5, ("event_id",)).select("event_id", "user_id")
