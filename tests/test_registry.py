"""Every registered query against its DuckDB statement on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
BASE = {name: query for name, query in entry.queries().items() if "llm" not in query.__module__ and name != "pipeline"}
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in BASE}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], ORACLE[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(BASE) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_every_statement_belongs_to_a_query():
    from oracle.statements import SQL

    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["city", "gmv", "orders"]
