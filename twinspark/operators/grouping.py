"""Groups of duplicates from an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspark.sources.written import materialize

#: Undecided links of greedy groups that the driver decides.
FINISH = 100_000


def _linked_to_least(pairs: DataFrame) -> DataFrame:
    """`pairs` (u, v) with m, the least of u and its v's; the least is gathered before the join, so a node with many
    links is summed up where its rows are."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least.hint("merge"), "u")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the least node of its component, found by alternating large
    and small stars.

    Self-links and null ends take no part; repeated links and an empty table are fine. Each round is written to the
    shared folder, so its lineage is one table; rounds are about the logarithm of the longest path.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _linked_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        linked = _linked_to_least(e)
        e = linked.select("u", F.col("m").alias("v")).unionByName(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = materialize(e, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def components(edges: DataFrame) -> DataFrame:
    """video_id and component (its least id) of every end of `edges` (query_id, video_id)."""
    found = connected(edges.select(F.col("query_id").alias("a"), F.col("video_id").alias("b")))
    return found.select(F.col("node").alias("video_id"), F.col("root").alias("component"))


def greedy_groups(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """group_id, video_id and place of groups taken in order of id: an id not seen starts a group of itself and its partners
    (query_id, video_id, rank), if that has another unseen member; partners may have been seen, all are then.

    The choice is made in rounds for all ids at once. Of each member two bounds are known: the least id that has begun a
    group with it (`seen`), and the least that has or still may (`may`). An id starts a group once no smaller one may hold
    it, nor some partner of it; it starts none once a smaller one has begun with it, or with each of its partners. The least
    undecided id is decided in every round, and so is each whose outcome hangs on decided ones, so rounds are as many as the
    longest chain of ids that wait for each other: few where ids stand in no order, many for a path along the ids. When at
    most `finish` links are undecided, the driver decides them in order; `finish` doesn't grow with the table.

    Joins are merges by hint: a broadcast would bring a table of each round to the driver, and rounds add up.

    Links of an id to itself, null ends and repeated links count for nothing. Members of many lists and long lists are summed
    up before they meet, and Spark splits the joins' large partitions.
    """
    links = edges.where("query_id <> video_id").groupBy(F.col("query_id").alias("q"), F.col("video_id").alias("m")).agg(F.min("rank").alias("rank"))
    links = materialize(links, "links")
    own = links.select("q", F.col("q").alias("m")).distinct()
    still = materialize(links.select("q", "m").unionByName(own), "open")
    seen = still.select("m", F.col("q").alias("seen")).limit(0)
    starters = []
    while (left := still.count()) > finish:
        known = still.groupBy("m").agg(F.min("q").alias("may")).join(seen.hint("merge"), "m", "left")
        known = known.select("m", F.least("may", "seen").alias("may"), "seen")  # least() passes over nulls
        member = still.join(known.hint("merge"), "m")
        itself, gone = F.col("m") == F.col("q"), F.coalesce(F.col("seen") < F.col("q"), F.lit(False))
        free = F.col("may") >= F.col("q")
        told = member.groupBy("q").agg(
            F.bool_or(itself & gone).alias("held"), F.bool_or(itself & free).alias("free"), F.bool_or(~itself & free).alias("other"), F.bool_and(itself | gone).alias("none"),
        )
        told = told.select("q", F.when(F.col("held") | F.col("none"), False).when(F.col("free") & F.col("other"), True).alias("starts"))
        both = materialize(still.join(told.hint("merge"), "q"), "open")
        starters.append(both.where("starts").select("q").distinct())
        seen = materialize(seen.unionByName(both.where("starts").select("m", F.col("q").alias("seen"))).groupBy("m").agg(F.min("seen").alias("seen")), "seen")
        still = both.where("starts IS NULL").select("q", "m")
        if len(starters) == 8:
            starters = [materialize(_all(starters), "starters")]  # the plan doesn't grow with the rounds
    if left:
        rest: dict = {}
        for r in still.join(seen.hint("merge"), "m", "left").collect():  # `finish` rows at most
            rest.setdefault(r["q"], []).append((r["m"], r["seen"]))
        starters.append(edges.sparkSession.createDataFrame([(q,) for q in _decided(rest)], links.select("q").schema))
    if not starters:
        starters.append(links.select("q").limit(0))
    begun = links.join(_all(starters).hint("merge"), "q", "left_semi")
    partners = begun.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("rank", "m")))  # a list each, of top-k partners
    first = begun.select("q").distinct().select(F.col("q"), F.col("q").alias("m"), F.lit(0).alias("place"))
    return first.unionByName(partners.select("q", "m", "place")).select(F.col("q").alias("group_id"), F.col("m").alias("video_id"), "place")


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _decided(lists: dict) -> list:
    """Which of the ids start a group; lists: for each the members, itself too, with the least id known to have seen them."""
    seen, out = set(), []
    for q in sorted(lists):
        unseen = [m for m, by in lists[q] if m not in seen and not (by is not None and by < q)]
        if q in unseen and len(unseen) > 1:
            out.append(q)
            seen.update(m for m, _ in lists[q])
    return out


def report(groups: DataFrame) -> DataFrame:
    """One row: num_groups, num_duplicates (members beyond the first of each group)."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("num_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("num_duplicates"))
