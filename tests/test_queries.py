from __future__ import annotations

import pytest
from conftest import SMALL, same

from tidemark.oracle import oracle_sql
from tidemark.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, SMALL), duck, oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
