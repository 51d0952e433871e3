"""Every query of the place engine against its oracle SQL, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else tuple(x) if isinstance(x, list) else x


def names():
    from placeweave.queries import ORACLE_SQL

    return sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", names())
def test_oracle(spark, duck, name):
    from placeweave.queries import ORACLE_SQL, QUERIES

    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    rel = duck.sql(ORACLE_SQL[name])
    columns = list(rel.columns)
    assert sorted(columns) == order
    theirs = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in rel.fetchall())
    assert ours == theirs


def test_entry_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
