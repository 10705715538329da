"""Registered queries with SQL against it, the others for their contract's columns."""

import duckdb
import pytest
from tradewind.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = con.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert ordered(got.select(names).collect()) == ordered(found.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in queries()
