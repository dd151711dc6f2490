"""Every query against its SQL on the small tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from eventloom.catalog.oracle import ORACLE
from eventloom.catalog.queries import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, duck.execute(ORACLE[name]).df()) is None
