import random
import re

import numpy as np
import pytest
import xxhash

from twinspark.operators.grouping import connected
from twinspark.llm.simhash import ROUTE, bucket_keys, chain_length, links, near_duplicates, one_of_each, told_here


def brute_fp(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(ids, fps, t):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array(fps, dtype=np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= t):
            root[find(int(j))] = find(i)
    least = {}
    for i in range(len(f)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(f))]


def test_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs += [(5000, None), (5001, ""), (5002, " \n"), (5003, "One two"), (5004, "one TWO"), (5005, "a b c d e"), (5005, "a b c d e")]
    df = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, f0 int")
    got = near_duplicates(df, 4, 4, 1).toPandas().sort_values(["doc_id"])
    fps = {a: brute_fp(b) for a, b in docs}
    assert [int(x) & (1 << 64) - 1 for x in got.f0] == [fps[a] for a in got.doc_id]
    ids = sorted(fps)
    want = dict(zip(ids, brute_components(ids, [fps[i] for i in ids], 4)))
    assert got.component_id.tolist() == [want[a] for a in got.doc_id]
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("chain", [2, 3])
@pytest.mark.parametrize("t", [0, 1, 2, 4, 8, 10])
def test_every_close_pair_meets_in_a_bucket(t, chain):
    rng = random.Random(t)
    a = [rng.getrandbits(64) for _ in range(200)]
    b = []
    for x in a:
        for bit in rng.sample(range(64), rng.randint(0, t)):
            x ^= 1 << bit
        b.append(x)
    ka, ra = bucket_keys(np.array(a, dtype=np.uint64), 0, t, chain)
    kb, rb = bucket_keys(np.array(b, dtype=np.uint64), 0, t, chain)
    assert {(int(k), int(r)) for k, r in zip(ka, ra)} and all({int(k) for k in ka[ra == i]} & {int(k) for k in kb[rb == i]} for i in range(200))


def test_links_of_large_buckets_connect_the_same():
    rng = np.random.default_rng(1)
    f = np.unique(rng.integers(0, 1 << 14, 3000).astype(np.uint64))
    i, j = links(f[:, None], 1)
    assert len(i) < 2 * len(f) and (np.bitwise_count(f[i] ^ f[j]) <= 1).all()
    want = brute_components(list(range(len(f))), f.tolist(), 1)
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        root[find(a)] = find(b)
    assert len({find(x) for x in range(len(f))}) == len(set(want))


def test_near_copies_with_defaults(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(600)]
    near = base[:300] + ["changed"] + base[301:]
    other = [f"w{rng.randrange(5000)}" for _ in range(600)]
    df = spark.createDataFrame([(3, " ".join(base)), (2, " ".join(near)), (9, " ".join(other)), (None, " ".join(base))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == {3: 2, 2: 2, 9: 9, None: 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300), (None, 3)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_link_is_told_in_the_least_shared_key():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 2).astype(np.uint64)
    f = base ^ np.array([[sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(2)] for _ in range(40)], dtype=np.uint64)
    keys = [set() for _ in f]
    for w in range(2):
        for k, r in zip(*bucket_keys(np.ascontiguousarray(f[:, w]), w, 6, 2)):
            keys[r].add(int(k))
    i, j = np.triu_indices(len(f), 1)
    shared = [sorted(keys[a] & keys[b]) for a, b in zip(i, j)]
    some = [n for n, s in enumerate(shared) if s]
    assert len(some) > 100
    for place in (0, -1):
        got = told_here(f, 6, 2, i[some], j[some], np.array([shared[n][place] for n in some], dtype=np.uint64))
        assert got.tolist() == [shared[n][0] == shared[n][place] for n in some]


def test_links_grow_with_the_group(spark, monkeypatch):
    """A cluster of near copies shares dozens of buckets; its links are told about once a member, and connect it."""
    from twinspark.llm import simhash

    rng = random.Random(4)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(400)], []
    for i in range(600):
        words = list(base)
        for at in rng.sample(range(400), 4):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    counted, inner = [], simhash.connected
    monkeypatch.setattr(simhash, "connected", lambda edges: inner((counted.append(edges.count()), edges)[1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {r.component_id for r in near_duplicates(df, route=ROUTE).collect()} == {0}
    assert 599 <= counted[0] < 6 * 600


def test_chains_grow_with_the_table():
    n = [chain_length(10**e, ROUTE.max_bits) for e in range(3, 11)]
    assert n[0] == 2 and n == sorted(n) and n[-1] >= 4 and chain_length(10, 0) == 1


def test_routed_pairs_at_the_bar(spark):
    """Of pairs with a similarity of 0.8 to 0.85 nine of ten link at least; hardly any of half of that."""
    rng, rows, band = random.Random(9), [], {}
    for i in range(160):
        a = [f"w{rng.randrange(8000)}" for _ in range(300)]
        b = list(a)
        while True:
            b[rng.randrange(300)] = f"y{rng.randrange(10**6)}"
            x, y = ({" ".join(t[k : k + 5]) for k in range(296)} for t in (a, b))
            j = len(x & y) / len(x | y)
            if j < (0.85 if i % 2 else 0.5):
                break
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        band[2 * i + 1] = j
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), route=ROUTE).collect()}
    linked = {d: got[d] == d - 1 for d in band}
    high, low = [linked[d] for d in band if band[d] >= 0.8], [linked[d] for d in band if band[d] < 0.5]
    assert len(high) > 70 and sum(high) >= 0.9 * len(high) and sum(low) <= 0.05 * len(low)


def test_one_of_each_removes_rows(spark):
    words = lambda seed, n=120: " ".join(f"w{random.Random(seed).randrange(10**6) + k * 7}" for k in range(n))
    a, b, long = words(1), words(2), "deep " * 200_000
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (9, b + " and four words more", 4), (5, words(3), 5), (5, words(3), 5), (11, None, 6), (12, "", 7), (13, long, 8), (14, long, 9), (None, a, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnsRenamed({"n": "keep_0"}).repartition(4)
    got = one_of_each(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    assert sorted(((r.doc_id, r.keep_0) for r in got.collect()), key=str) == sorted([(3, 1), (7, 3), (5, 5), (11, 6), (13, 8), (None, 10)], key=str)
    assert one_of_each(df.limit(0)).count() == 0


def test_exact_similarity_decides(spark):
    """Pairs in which one piece is replaced, with a similarity just over the bar or well under it."""
    rng, rows, band = random.Random(21), [], {}
    for i in range(160):
        a = [f"w{rng.randrange(9000)}" for _ in range(300)]
        n = rng.randrange(22, 29) if i % 2 else rng.randrange(38, 60)
        at = rng.randrange(300 - n)
        b = a[:at] + [f"z{rng.randrange(10**6)}" for _ in range(n)] + a[at + n :]
        x, y = ({" ".join(t[k : k + 5]) for k in range(296)} for t in (a, b))
        band[2 * i + 1] = len(x & y) / len(x | y)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    kept = {r.doc_id for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    high, low = [d for d in band if band[d] >= 0.8], [d for d in band if band[d] < 0.8]
    assert len(high) > 60 and sum(d not in kept for d in high) >= 0.9 * len(high)
    assert len(low) > 60 and all(d in kept for d in low) and all(2 * i in kept for i in range(160))


def test_a_group_hangs_on_its_original(spark):
    """Copies are like the original, not like each other: whatever tree of links is told, one of them all stays."""
    rng, rows = random.Random(8), []
    base = [f"w{rng.randrange(9000)}" for _ in range(400)]
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(400), 0 if i == 31 else 8):
            words[at] = f"q{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) <= 3 and 0 in {r.doc_id for r in got}


def brute_kept(rows, bar=0.8):
    """Ids that stay of (id, text): the least of each component of pairs at the bar, by comparing all pairs."""
    sets = [set(" ".join(t[k : k + 5]) for k in range(max(1, len(t) - 4))) if (t := (text or "").lower().split()) else set() for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] == sets[j] or n and n / (len(sets[i]) + len(sets[j]) - n) >= bar - 1e-12:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return set(least.values())


def test_no_pair_at_the_bar_is_left_out(spark):
    """A piece is replaced, of a size at which similarities lie around the bar."""
    rng, rows = random.Random(33), []
    for i in range(150):
        n = rng.choice([5, 12, 60, 300])
        a = [f"w{rng.randrange(9000)}" for _ in range(n)]
        cut = max(1, round(n * rng.uniform(0.02, 0.14)))
        at = rng.randrange(n - cut + 1)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a[:at] + [f"z{rng.randrange(10**6)}" for _ in range(cut)] + a[at + cut :]))]
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, "one")]
    kept = {r.doc_id for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == brute_kept(rows) and 170 < len(kept) < 290


@pytest.mark.parametrize("few", [0, 10**6])
def test_large_buckets_lose_no_pair(spark, monkeypatch, few):
    """One passage in every text, in buckets that are cut and whose pairs aren't all met at first: copies of it are linked in
    chains, stars and not at all."""
    from twinspark.llm import near

    monkeypatch.setattr(near, "SMALL", 3)
    monkeypatch.setattr(near, "HELD", 10)
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "HUB_ROUNDS", 2)
    rng = random.Random(12)
    base, rows = [f"w{i}" for i in range(90)], []
    for i in range(120):
        words = list(base)
        cut = rng.choice([0, 3, 6, 9, 12, 14])
        at = rng.randrange(90 - cut)
        words[at : at + cut] = [f"x{rng.randrange(10**6)}" for _ in range(cut)]
        rows.append((i, " ".join(words + (["tail"] * 40 if i % 9 == 4 else []))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        kept = {r.doc_id for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert kept == brute_kept(rows) and 1 < len(kept) < 120


def test_parities_rule_out_no_similar_pair():
    from twinspark.llm.near import least_difference, parities

    rng = np.random.default_rng(3)
    for n, extra, gone in [(0, 0, 0), (0, 1, 0), (1, 0, 0), (5, 1, 1), (40, 3, 2), (400, 40, 5), (5000, 900, 300), (300, 9000, 0), (3000, 3000, 3000)]:
        h = np.unique(rng.integers(0, 2**64, n + extra, np.uint64, endpoint=False))
        x, y = h[: len(h) - extra], h[min(gone, n) :]
        true, least = len(np.setxor1d(x, y)), least_difference(parities(x), parities(y))
        assert least <= true == extra + min(gone, n) and least % 2 == true % 2
        assert least == least_difference(parities(y), parities(x)) and (least >= 0.6 * true or true > 0.3 * n)
    a, b = (rng.integers(0, 2**64, 400, np.uint64, endpoint=False) for _ in range(2))
    assert least_difference(parities(a), parities(b)) > 0.2 / 1.8 * 800  # sets without a common part are told apart


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_a_full_sieve_changes_nothing(spark, monkeypatch, bits):
    from twinspark.llm import common

    monkeypatch.setattr(common, "SIEVE", bits)
    rows, wanted = spark.range(0, 3000).selectExpr("id % 7 AS file", "id AS at"), spark.range(0, 3000, 3).selectExpr("id % 7 AS file", "id AS at")
    found = common.sifted(rows, wanted, ["file", "at"])
    assert found.count() == 3000 and found.where("sifted").join(wanted, ["file", "at"]).count() == 1000
    assert (found.where("sifted").count() > 2900) == (bits == 64)
    assert common.sifted(rows, wanted.limit(0), ["file", "at"]).where("sifted").count() == 0


def test_sets_of_shingles_are_not_written(spark, tmp_path, monkeypatch):
    """Texts with a passage in common, so that all are proposed to each other: what is written is far less than their shingles."""
    from twinspark.llm import near
    from twinspark.sources import written

    monkeypatch.setattr(near, "FREQUENT", 10**9)
    monkeypatch.setattr(written, "place", lambda spark, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(400)] + passage + [f"w{rng.randrange(10**6)}" for _ in range(400)])) for i in range(120)]
    rows.append((500, rows[7][1] + " tail"))
    kept = {r.doc_id for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(120))
    sizes = {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in tmp_path.iterdir() if not p.name.startswith("rows")}
    assert 0 < sum(sizes.values()) < 4 * 860 * len(rows), sizes  # 8 bytes a shingle, and once more for proposed sets, before
