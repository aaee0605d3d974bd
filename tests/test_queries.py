"""Every registered query against its check SQL on the smallest tables."""

from __future__ import annotations

import pytest
from check import compare, connect

from huntframe.plans.oracles import ORACLES
from huntframe.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_check_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_check_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""
