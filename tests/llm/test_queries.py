"""Every query with a statement against it, and the registry."""

import pytest

import __spark_entry__ as entry
from platter.llm.queries import QUERIES, SQL
from tests.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert compare(spark, duck(SF_DIR), QUERIES[name], SQL[name], SF_DIR) is None


def test_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op"))
    assert numbers == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(QUERIES) <= set(entry.queries())
