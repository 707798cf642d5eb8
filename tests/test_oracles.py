"""Every registered query with SQL against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from shopweave.queries import basket_queries, catalog_queries, column_queries, discovery_queries, search_queries

GROUPS = [column_queries, catalog_queries, search_queries, basket_queries, discovery_queries]
QUERIES = {k: q for g in GROUPS for k, q in g.QUERIES.items()}
ORACLES = {k: q for g in GROUPS for k, q in g.ORACLES.items()}


def plain(rows):
    one = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)
    return sorted(([one(v) for v in r] for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = plain(df.select(*cols).collect())
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    assert found == plain(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
