"""Every named query on the smallest tables, next to its SQL where there is one."""

import os

import pytest

import __spark_entry__ as contract
from compare import duck, duck_rows, spark_rows

SF = os.environ.get("CORPUSLOOM_SF", "/root/testdata/sf0.001")
QUERIES = contract.queries()
SQL = contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    if name not in SQL:
        assert rows
        return
    want_columns, want = duck_rows(con, SQL[name])
    assert columns == want_columns
    assert rows == want


def test_entry(spark):
    assert contract.entry(spark).count() == 20
    assert set(SQL) <= set(QUERIES)
