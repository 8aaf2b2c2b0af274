"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import check, duck

from folioquery.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = check(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
