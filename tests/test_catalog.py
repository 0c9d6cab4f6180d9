"""Every registered query that has SQL against it, at the smallest scale."""

import pytest

from conftest import SF
from oracle_compare import compare, duck

import __spark_entry__ as entry_module

# the queries of the optional subpackage have their own tests
NAMES = sorted(n for n in entry_module.oracle_sql() if n in entry_module.query_table())


def test_contract():
    q, o = entry_module.queries(), entry_module.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "net_rtg" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    same, note = compare(entry_module.queries()[name](spark, SF), duck(SF), entry_module.oracle_sql()[name])
    assert same, note
