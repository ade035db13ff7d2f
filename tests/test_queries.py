"""Every named query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from check_oracles import check, connect

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    problem, _ = check(spark, con, SF_DIR, name)
    assert problem is None


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["i", "y0", "y1", "y2", "y3"] and out.count() > 0
