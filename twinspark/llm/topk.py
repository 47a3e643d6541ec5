"""Exact top-k by inner product with MaxScore.

A vector's terms are its dimensions. Within a shard, a term's contribution is counted from its least, so that it is never
negative and has an upper bound |q| * (max - min). Terms are taken by falling bound: while the bounds of those left could
lift a candidate over the k-th score known so far, they are essential and the postings of the next one are traversed for
all candidates; once they can't lift new ones, the rest are non-essential and only candidates that are still competitive
are probed, until none of the rest could change the outcome. A shard starts from the k-th score over a small set of
candidates that all shards know, and gives at most k hits a query; hits of all shards are merged.

Queries pass over the table in blocks of bounded size, each broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspark.sources.written import materialize

#: Queries of a block, blocks whose hits are written together, and candidates that give the first threshold.
QUERY_BLOCK = 8192
BLOCKS_WRITTEN = 16
SEEDS = 512
#: Candidates of a shard that are scored at once.
ROWS = 8192
#: Non-essential terms probed between two looks at the bounds.
STEP = 16


def _scores_fit(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether sums of products are exact in float64."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return most < 2**53


def _merge(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then id."""
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


class Shard:
    """Candidates of one block with the bounds of their terms."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.columns = np.ascontiguousarray(x.T)

    def search(self, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, scores, ids) of up to k candidates each whose score is at least `floor`; ids differ from the query's."""
        least = np.where(q > 0, q * self.low, q * self.high)
        bound = np.where(q > 0, q * self.high, q * self.low) - least
        order = np.argsort(-bound, axis=1)
        for i in range(len(q)):
            terms, theta = order[i], floor[i]
            # what all terms from the j-th on can add, at most
            rest = np.append(np.cumsum(bound[i, terms][::-1])[::-1], 0)
            base = least[i].sum()
            if base + rest[0] < theta:
                continue
            # essential terms: what has none of them can't reach theta; their postings are traversed
            short = base + rest < theta
            at = max(1, int(np.argmax(short)) if short.any() else len(terms))
            first = terms[:at]
            part = q[i, first] @ self.columns[first] + least[i, terms[at:]].sum()
            # rows of the query's own id are no hits, so they must not lift theta
            live = np.flatnonzero((part + rest[at] >= theta) & (self.ids != query_ids[i]))
            part = part[live]
            if len(live) > k:
                theta = max(theta, np.partition(part, len(part) - k)[len(part) - k])
            while at < len(terms) and len(live):  # the others are probed for what is still competitive
                to = min(len(terms), at + STEP)
                some = terms[at:to]
                part = part + self.x[np.ix_(live, some)] @ q[i, some] - least[i, some].sum()
                at = to
                if len(live) > k:  # what is sure already may lift theta
                    theta = max(theta, np.partition(part, len(part) - k)[len(part) - k])
                keep = part + rest[at] >= theta
                live, part = live[keep], part[keep]
            if len(live):
                yield (i, *_merge(part, self.ids[live], k))


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by `every` the k rows of highest score.

    Components become floor(scale * x); the score is the integer inner product; ties go to the smaller id; a row is no
    candidate of a query with its id. Vectors that are null, empty or hold nulls or non-finite components, null ids, and
    vectors of another length than a query's take no part for it. Rows repeated with the same id and vector count once;
    rows that share an id but differ are candidates (and queries) each. Sums beyond 2^53 are computed in exact integers; a score
    beyond 64 bits is an error.
    """
    spark = df.sparkSession
    vec = F.col(vector_col)
    ok = F.col(id_col).isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec, lambda x: F.floor(x.cast("double") * float(scale))).alias("x"))
    # repeated rows must not take places of a shard's k best, nor lift its threshold; written once for all blocks
    rows = materialize(rows.distinct(), "vectors")
    queries = materialize(rows.where(F.col("vec_id") % every == 0), "queries")
    blocks = max(1, -(-queries.count() // query_block))
    # by hash of the id; a block has about `query_block` rows
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).toPandas()
    found = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toPandas()
        if not len(part):
            continue
        for width in sorted(set(part.x.map(len))):
            one = part[part.x.map(len) == width].sort_values("vec_id").reset_index(drop=True)
            hits = _pass(rows, one, seeds[seeds.x.map(len) == width], width, k)
            found = hits if found is None else found.unionByName(hits)
        if found is not None and block % BLOCKS_WRITTEN == BLOCKS_WRITTEN - 1:
            found = materialize(found, "hits")  # the plan doesn't grow with the blocks
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _pass(rows: DataFrame, queries, seeds, width: int, k: int) -> DataFrame:
    """Hits of one block of queries of one vector length, at most k a query and shard."""
    exact = np.array(queries.x.tolist(), dtype=np.int64).reshape(-1, width)
    ids = queries.vec_id.to_numpy()
    s = np.array(seeds.x.tolist(), dtype=np.int64).reshape(-1, width)
    floor = np.full(len(ids), -np.inf)
    if len(s) > k + 1 and _scores_fit(exact, s):
        known = exact.astype(float) @ s.T.astype(float)
        known[ids[:, None] == seeds.vec_id.to_numpy()[None, :]] = -np.inf
        # repeated ids among the seeds must not count twice
        distinct = np.unique(seeds.vec_id.to_numpy(), return_index=True)[1]
        if len(distinct) > k + 1:
            known = known[:, distinct]
            floor = np.partition(known, known.shape[1] - k, axis=1)[:, known.shape[1] - k]
    spec = rows.sparkSession.sparkContext.broadcast((ids, exact, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q, theta = spec.value
        theta, best = theta.copy(), {}
        for b in batches:
            lists = b.column(1)
            of_width = np.flatnonzero(lists.value_lengths().to_numpy(zero_copy_only=False) == width)
            b = b.take(pa.array(of_width))
            all_ids, all_x = b.column(0).to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for at in range(0, len(all_ids), ROWS):
                v, x = all_ids[at : at + ROWS], all_x[at : at + ROWS]
                fit = _scores_fit(q, x)
                kind = np.float64 if fit else object
                shard = Shard(v, x.astype(kind)) if fit else None
                for i, score, hit in shard.search(query_ids, q.astype(kind), theta, k) if fit else _plain(v, x, query_ids, q, k):
                    old = best.get(i)
                    if old:
                        both = zip([*old[0], *score], [*old[1], *hit])
                        score, hit = map(list, zip(*sorted(both, key=lambda p: (-p[0], p[1]))[:k]))
                    best[i] = (list(score), list(hit))
                    if len(best[i][1]) == k and fit:
                        theta[i] = max(theta[i], float(best[i][0][-1]))
        out = [(int(query_ids[i]), int(h), int(s)) for i, (score, hit) in best.items() for s, h in zip(score, hit)]
        cols = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def _plain(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, list, list]]:
    """Scores in Python's integers, for components too large for exact float64 sums."""
    for i in range(len(q)):
        own = ids != query_ids[i]
        score = (x[own].astype(object) * q[i].astype(object)).sum(axis=1)
        order = sorted(range(len(score)), key=lambda j: (-score[j], ids[own][j]))[:k]
        yield i, [score[j] for j in order], [ids[own][j] for j in order]
