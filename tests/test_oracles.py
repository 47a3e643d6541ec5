import math

import duckdb
import pytest

from twinspark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert df.collect()  # count() would prune what is to be checked
        return
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({ORACLES[name]})").fetchall()
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key)
    want = sorted((tuple(map(plain, r)) for r in want), key=key)
    assert len(got) == len(want) and got
    for g, w in zip(got, want):
        assert all(type(a) is type(b) and (a == b or isinstance(a, float) and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)) for a, b in zip(g, w)), (g, w)
