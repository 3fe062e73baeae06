"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in SQL:
        assert found
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert found == sorted(repr(tuple(r[i] for i in places)) for r in result.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["claim_id", "split", "train_location_claim_count", "train_shared_location_degree"]
    assert df.count() == 1500


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
