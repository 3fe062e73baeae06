"""Every query of the text operators gives rows, the same as its SQL where there is one."""

import duckdb
import pytest

from riskloom.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF

TABLES = "documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    if name == "op12_prefix_trie":
        assert df.where("depth = 0").first()["n_convs"] == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
        return
    table, key = ("conversations", "conv_id") if name == "op11_repair" else ("documents", "doc_id")
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()
