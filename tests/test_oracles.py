"""Every lineage query that has SQL gives the same rows in DuckDB."""

import duckdb
import pandas as pd
import pytest

from tracelake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "null" if x != x else f"{x:.9g}"
    if hasattr(x, "tolist") and not isinstance(x, str):
        x = x.tolist()
        return plain(x) if isinstance(x, float) else str(x)
    return "null" if x is None or x is pd.NaT or x is pd.NA else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.columns
        got.limit(1).collect()
        return
    got, want = got.toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_sql_has_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert catalog.FLAGSHIP in QUERIES
