import duckdb
import pytest

from scoreloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(tuple, cursor.fetchall()), key=str)
    got = QUERIES[name](spark, DATA)
    assert set(columns) == set(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == want
