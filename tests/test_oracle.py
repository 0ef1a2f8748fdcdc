"""Every registered query against its SQL. SF_DIR chooses the scale."""

import os

import pytest

from checks.compare import check, connect
from checks.oracle import all_oracles
from checks.queries import all_queries

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", all_queries())
def test_query_equals_sql(spark, duck, name):
    _, wrong = check(all_queries()[name](spark, SF_DIR), duck, all_oracles()[name])
    assert wrong is None
