"""Sharding by sampled splitters, in DataFrame operations alone.

Rows are ordered by (hash of the text, id): equal texts stand together. A sample in which a row's chance grows with its
size gives splitters at equal quantiles of bytes, many to a shard; they cut the key space into ranges. Ranges that turn
out overfull get splitters of their own from a sample within them, so that no task has more than a small share of the
bytes, one text of very many rows included (its range is cut by id). Exact sums by range then give each row its place in
the order of all rows, without a sort of all rows in one task, and the place gives shard and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinspark.sources.written import materialize

SHARDS = 24
RANGES = 128
#: Sampled rows for each range, so the sample has about SHARDS * RANGES * DRAWS rows whatever the input.
DRAWS = 8
#: Equal texts of up to so many ranges' bytes, or the largest row's, are kept in one range.
WHOLE = 4
#: A range of more than this many times its due share of bytes is overfull.
OVERFULL = 2.0
#: Rounds of subdividing; ranges that stay overfull cost time in a task, not balance.
ROUNDS = 8
CELLS = 4096

KEY = ("h", "id", "row")


def _draw(rows: DataFrame, chance: Column, seed: int) -> DataFrame:
    u = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(u < chance).withColumn("weight", F.col("size") / F.least(chance, F.lit(1.0)))


def _splitters(sample: DataFrame, within: list[str], ranges: Column, whole: float) -> DataFrame:
    """Keys at quantiles of the sample's weight, `ranges` of them to each group `within`.

    The first splitter of a text moves to the text's begin; a text that weighs less than `whole` has no other.
    """
    by = Window.partitionBy(*within)
    upto = by.orderBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.floor(F.sum("weight").over(upto) * ranges / F.sum("weight").over(by))
    marked = sample.withColumn("text_weight", F.sum("weight").over(Window.partitionBy(*within, "h"))).withColumn("q", q).withColumn("was", F.coalesce(F.lag("q").over(by.orderBy(*KEY)), F.lit(0))).where("q > was")
    first = F.row_number().over(Window.partitionBy(*within, "h").orderBy("id", "row")) == 1
    marked = marked.withColumn("first", first).where(F.col("first") | (F.col("text_weight") >= whole))
    first = F.col("first")
    least = F.lit(-(1 << 63)).cast("long")
    return marked.select("h", F.when(first, least).otherwise(F.col("id")).alias("id"), F.when(first, least).otherwise(F.col("row")).alias("row"))


def _with_range(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """Number of splitters at or under each row's key, looked up by the hash's first bits; the table has CELLS rows."""
    cell = F.shiftright("h", 52)
    lists = splitters.groupBy(cell.alias("cell")).agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("cuts"))
    cells = rows.sparkSession.range(-CELLS // 2, CELLS // 2).select(F.col("id").alias("cell"))
    table = cells.join(lists, "cell", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<h:bigint,id:bigint,row:bigint>>")))
    before = F.sum(F.size("cuts")).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    table = table.withColumn("before", F.coalesce(before, F.lit(0)))
    joined = rows.withColumn("cell", cell).join(F.broadcast(table), "cell")
    key = F.struct(*KEY)
    return joined.withColumn("range", (F.col("before") + F.size(F.filter("cuts", lambda c: c <= key))).cast("int")).drop("cell", "cuts", "before")


def shard(df: DataFrame, shards: int = SHARDS, ranges: int = RANGES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null) of each row.

    size is the text's UTF-8 bytes plus 8. A shard's size is off the mean by half of a group of equal
    texts at each end, of at most WHOLE of its `ranges` ranges or the largest row; larger groups are cut, others are not. Null texts are empty, null ids sort first, rows that tie
    (repeated rows) have a slot each, an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    )
    keyed = materialize(keyed, "keyed")
    total, largest = (x or 1 for x in keyed.agg(F.sum("size"), F.max("size")).first())
    due = total / (shards * ranges)
    whole = max(WHOLE * due, largest)
    one = keyed.select(*KEY, "size").withColumn("all", F.lit(0))
    sample = _draw(one, F.col("size") * F.lit(shards * ranges * DRAWS / total), 1)
    splitters = materialize(_splitters(sample, ["all"], F.lit(shards * ranges), whole), "splitters")
    for seed in range(2, ROUNDS + 2):
        ranged = _with_range(keyed, splitters)
        stats = materialize(ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "ranges")
        overfull = stats.where((F.col("bytes") > OVERFULL * max(due, whole)) & (F.col("n") > 1))
        if overfull.isEmpty():
            break
        rows = ranged.join(F.broadcast(overfull), "range").select(*KEY, "size", "range", "bytes")
        parts = F.ceil(F.col("bytes") / F.lit(due))
        more = _splitters(_draw(rows, F.col("size") * parts * DRAWS / F.col("bytes"), seed).withColumn("parts", parts), ["range"], F.col("parts"), whole)
        more = materialize(splitters.unionByName(more).distinct(), "splitters")
        if more.count() == splitters.count():
            break
        splitters = more
    # a row for each range: bounded by the number of splitters
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = stats.select("range", F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("rows_before"))
    by, of_text = Window.partitionBy("range"), Window.partitionBy("range", "h")
    text_end = F.sum("size").over(by.orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = _with_range(keyed, splitters).join(F.broadcast(before), "range")
    placed = placed.withColumn("middle", 2 * (F.col("bytes_before") + text_end) - F.sum("size").over(of_text))
    placed = placed.withColumn("shard", F.least(F.expr(f"cast(middle * {shards} div {2 * total} as int)"), F.lit(shards - 1)))
    placed = placed.withColumn("place", F.col("rows_before") + F.row_number().over(by.orderBy(*KEY)) - 1)
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "place"), "placed")
    begins = placed.groupBy("shard").agg(F.min("place").alias("begin"))  # a row a shard
    return placed.join(F.broadcast(begins), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("begin")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
