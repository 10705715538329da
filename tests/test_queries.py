"""Every registered query against its SQL twin."""

import pytest

from checks.compare import database, difference
from checks.oracle import oracle_sql
from checks.queries import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_rows(spark, con, name):
    assert difference(spark, con, FOLDER, name) is None
