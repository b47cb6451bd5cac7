"""Every query that SQL can express against DuckDB, on the smallest tables."""

import duckdb
import pytest

from tagflow import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    want = db.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    expected = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == expected


#: What SQL cannot express, and the test that holds it against brute force.
OTHERWISE = {"Q20_content_dedup": "test_chunks.py"}


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(SQL) | set(OTHERWISE) == set(QUERIES) and not set(SQL) & set(OTHERWISE)
