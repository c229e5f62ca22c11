"""Every query with SQL gives the same rows as that SQL; the rest runs."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import SF
from tools_check import TABLES, canonical

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
SLOW = ("grid", "logistic_random", "job_09", "md_07", "job_10", "job_11", "md_20_deletion", "md_21_logistic")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    want = con.execute(SQL[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    a = sorted(map(canonical, zip(*[got[c].to_pylist() for c in names])))
    e = sorted(map(canonical, zip(*[want[c].to_pylist() for c in names])))
    assert a == e


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not any(s in n for s in SLOW)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry_module.entry(spark).count() == 2
