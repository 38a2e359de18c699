"""Each registered query of the engine against its SQL in DuckDB, and its plan."""

import os

import duckdb
import pytest

from tidemark.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def same(spark_table, duck_table):
    names = sorted(spark_table.column_names)
    assert names == sorted(duck_table.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t[c].to_pylist() for c in names))))
    assert rows(spark_table) == rows(duck_table)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    same(queries.QUERIES[name](spark, SF).toArrow(), duck.execute(queries.SQL[name]).to_arrow_table())


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    bounded = plan(queries.scan_last_n(spark, SF))
    assert "TakeOrderedAndProject" in bounded and "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in bounded
    assert "props" not in bounded.split("ReadSchema")[1]
    assert "GreaterThanOrEqual(ts" in plan(queries.merged_replay(spark, SF))
    asof = plan(queries.asof_join_le(spark, SF))
    assert "Join" not in asof and asof.count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in plan(queries.last_n_per_symbol(spark, SF))
