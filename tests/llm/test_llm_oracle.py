"""The corpus queries that SQL can express give the same rows in DuckDB."""

import duckdb
import pytest

from tilewright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    r = con.execute(queries.oracle_sql()[name])
    theirs = [x[0] for x in r.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert sorted(tuple(x[c] for c in columns) for x in df.collect()) == sorted(tuple(x[i] for i in at) for x in r.fetchall())


def test_names():
    names = list(queries.queries())
    assert names[0] == "pipeline" and [int(n[2:].split("_")[0]) for n in names[1:]] == list(range(1, 11))
