"""Every inventory query against SQL that was written apart from it."""

import pytest

from hostlens.oracles import SQL
from hostlens.queries import QUERIES

from oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    check(spark, con, QUERIES[name], SQL[name], SF)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_entry_without_the_training_part(monkeypatch):
    """Where it, or a package that it needs, can't be imported, the other queries stay."""
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(SQL)
