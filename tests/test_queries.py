"""Every registered query against its SQL; those without SQL must give rows."""

import pytest

import __spark_entry__ as entry
import compare


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf_dir, name):
    message, _, ok = compare.compare(spark, con, sf_dir, name)
    assert ok, message


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.total_rows for r in rows) == 1500
