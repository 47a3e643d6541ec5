"""Retrieval metrics over long tables.

`scored`: query_id, video_id, score. `truth`: query_id, video_id. Order is by falling score, then smaller id. Every
metric is windows by query and an aggregate; only pooled precision ranks all pairs together, and does so by a sort by
ranges whose running counts are carried over (`running_ranks`), not in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspark.sources.written import materialize

#: Rows of a range that is ranked in one task.
RANGE_ROWS = 1_000_000


def relevant(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """`scored` with rel, 1 for pairs that `truth` has."""
    t = truth.select("query_id", "video_id").distinct().withColumn("rel", F.lit(1))
    return scored.join(t, ["query_id", "video_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def average_precision(scored: DataFrame, truth: DataFrame, empty: str = "skip") -> DataFrame:
    """query_id and ap: precision at each hit, summed, over the number of true ones.

    Queries without true ones: `skip` leaves them out, `zero` gives 0, `null` gives null.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id").rowsBetween(Window.unboundedPreceding, 0)
    r = relevant(scored, truth).withColumn("tp", F.sum("rel").over(w)).withColumn("rn", F.count(F.lit(1)).over(w))
    s = r.groupBy("query_id").agg(F.sum(F.col("rel") * F.col("tp") / F.col("rn")).alias("s"))
    n = truth.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    out = s.join(n, "query_id", "inner" if empty == "skip" else "left")
    ap = F.col("s") / F.col("n")
    return out.select("query_id", (F.coalesce(ap, F.lit(0.0)) if empty == "zero" else ap).alias("ap"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    return ap.agg(F.avg("ap").alias("map"), F.count("*").alias("queries"))


def running_ranks(df: DataFrame, order: list, value: str, rows: int = RANGE_ROWS) -> DataFrame:
    """`df` with rn (rank over all rows) and tp (running sum of `value`): a sort by ranges of about `rows` rows, running
    counts within each range, and the counts of the ranges before."""
    parts = max(4, -(-df.count() // rows))
    dealt = df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # written, so that both uses see the same ranges, whatever is run again
    local = materialize(dealt.withColumn("rn0", F.count(F.lit(1)).over(w)).withColumn("tp0", F.sum(value).over(w)), "ranks")
    sums = local.groupBy("part").agg(F.max("rn0").alias("n"), F.max("tp0").alias("t"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n"), F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("t"))
    # a row a range: a millionth of the table
    return local.join(F.broadcast(before), "part").withColumn("rn", F.col("rn0") + F.col("n")).withColumn("tp", F.col("tp0") + F.col("t")).drop("part", "rn0", "tp0", "n", "t")


def ranks_within(df: DataFrame, key: str, order: list) -> DataFrame:
    """`df` with place, from 1 in each group of equal `key`, where a few keys may hold most of the rows: ranks over all rows
    with the key first in the order, less those of the keys before. `order` must leave no ties."""
    r = running_ranks(df.withColumn("one", F.lit(1)), [F.col(key), *order], "one").drop("tp", "one")
    first = r.groupBy(F.col(key).alias("of")).agg(F.min("rn").alias("first"))
    return r.join(first, F.col(key).eqNullSafe(F.col("of"))).withColumn("place", F.col("rn") - F.col("first") + 1).drop("rn", "of", "first")


def pooled_average_precision(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """One row, uap: all pairs ranked together."""
    r = running_ranks(relevant(scored, truth), [F.desc("score"), F.col("query_id"), F.col("video_id")], "rel")
    n = truth.distinct().agg(F.count("*").alias("n"))
    return r.agg(F.sum(F.col("rel") * F.col("tp") / F.col("rn")).alias("s")).join(n, F.lit(True)).select((F.col("s") / F.col("n")).alias("uap"))


def trapezoid_average_precision(scored: DataFrame, truth: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """query_id and ap by trapezoids under the precision-recall line; `ignored` (video_id) take no rank."""
    r = relevant(scored, truth)
    if ignored is not None:
        r = r.join(ignored.select("video_id").distinct().withColumn("ig", F.lit(1)), "video_id", "left").withColumn("ig", F.coalesce("ig", F.lit(0)))
    else:
        r = r.withColumn("ig", F.lit(0))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("rank", F.row_number().over(by) - 1 - F.coalesce(F.sum("ig").over(before), F.lit(0)))
    hits = r.where("rel = 1 and ig = 0").withColumn("ntp", F.row_number().over(by) - 1)
    y0 = F.when(F.col("rank") == 0, 1.0).otherwise(F.col("ntp") / F.nullif(F.col("rank"), F.lit(0)))
    area = (F.col("ntp") + 1) / (F.col("rank") + 1) + y0
    n = truth.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    sums = hits.groupBy("query_id").agg(F.sum(area).alias("s"))
    return n.join(sums, "query_id", "left").select("query_id", F.coalesce(F.col("s") / F.col("n") / 2, F.lit(0.0)).alias("ap"))


def labelled_average_precision(scored: DataFrame, labels: DataFrame, excluded: DataFrame | None = None, all_videos: bool = False, positive: str = "ESLMV") -> DataFrame:
    """One row, map, over queries: videos of `labels` (query_id, video_id, label) alone are ranked, or all; `excluded` pairs are not."""
    r = scored.join(labels, ["query_id", "video_id"], "left")
    true = labels.where(F.col("label").isin(*positive))
    if excluded is not None:
        r, true = (x.join(excluded, ["query_id", "video_id"], "left_anti") for x in (r, true))
    if not all_videos:
        r = r.where(F.col("label").isNotNull())
    ap = average_precision(r.select("query_id", "video_id", "score"), true, "zero")
    n = scored.select("query_id").distinct().agg(F.count("*").alias("n"))
    return ap.agg(F.sum("ap").alias("s")).join(n, F.lit(True)).select((F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("map"))


def task_grid(scored: DataFrame, annotation: DataFrame, tasks: dict[str, list[str]], easy: DataFrame) -> DataFrame:
    """task, variant (all, hard), map and uap-free count: each task's labels are true; `hard` leaves out `easy` videos."""
    rows = [(t, lab) for t, labs in tasks.items() for lab in labs]
    spark = scored.sparkSession
    grid = F.broadcast(spark.createDataFrame(rows, "task string, label string"))
    both = F.explode(F.array(F.lit("all"), F.lit("hard"))).alias("variant")
    is_easy = easy.select("video_id").distinct().withColumn("easy", F.lit(True))
    hard = ~((F.col("variant") == "hard") & F.coalesce("easy", F.lit(False)))
    true = annotation.join(grid, "label").join(is_easy, "video_id", "left").select("task", "query_id", "video_id", "easy", both).where(hard).select("task", "variant", "query_id", "video_id").distinct()
    names = F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task")
    pairs = scored.join(is_easy, "video_id", "left").select("*", both).where(hard).select("query_id", "video_id", "score", "variant", names)
    # a query of a task and variant is a query of its own
    q = F.concat_ws("|", "task", "variant", F.col("query_id").cast("string")).alias("query_id")
    ap = average_precision(pairs.select(q, "video_id", "score"), true.select(q, "video_id"))
    part = F.split("query_id", r"\|")
    return ap.select(part[0].alias("task"), part[1].alias("variant"), "ap").groupBy("task", "variant").agg(F.avg("ap").alias("map"), F.count("*").alias("queries"))
