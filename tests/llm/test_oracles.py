import duckdb
import pytest

from twinspark.llm import queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    cols = sorted(d[0] for d in want.description)
    want = sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()))
    got = sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, SF).select(*cols).collect())
    assert len(got) == len(want) and got == want
