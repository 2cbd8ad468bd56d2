"""Every query with a SQL twin gives the same rows as DuckDB; the others run."""

import pytest

import __spark_entry__ as entry
import harness
from conftest import SF
from foliospark.plans import catalogue
from foliospark.plans.catalogue import load_all

load_all()
QUERIES, ORACLE = dict(catalogue.QUERIES), dict(catalogue.ORACLE)


@pytest.fixture(scope="module")
def con():
    return harness.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    assert harness.difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
