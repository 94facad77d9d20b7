"""Every registered query against its SQL on a second engine."""

import pytest
from compare import compare, connect
from conftest import SMALL

import __spark_entry__ as entry

BUILDERS, SQL = entry.queries(), entry.oracle_sql()
ROWS_ONLY = {"bytes_per_row"}
#: Optional queries without SQL have tests of their own.
OPTIONAL = {n for n in BUILDERS if n.startswith("op") and n[2].isdigit() or n == "pipeline"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(set(SQL) - OPTIONAL))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, name, BUILDERS[name], SQL[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_gives_rows(spark, name):
    assert BUILDERS[name](spark, SMALL).count() > 0


def test_only_known_queries_lack_sql():
    assert set(BUILDERS) - set(SQL) - OPTIONAL == ROWS_ONLY


def test_entry(spark):
    assert entry.entry(spark).count() > 0
