"""Every registered query next to its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from saldo import queries as registry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_every_query_has_sql():
    assert set(registry.oracle_sql()) == set(registry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
