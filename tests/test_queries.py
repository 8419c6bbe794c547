"""Every query with an oracle against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from ripplegraph.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(str(x) for x in r) for r in df[columns].itertuples(index=False))


def test_all_queries_have_oracles():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SMALL).toPandas()) == rows(duck.sql(catalog.ORACLES[name]).df())
