import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check
import __spark_entry__ as entry
from tallyflow.registry.base import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.oracle(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_agrees_with_duckdb(spark, con, key):
    ok, note, _ = check.compare(spark, con, key, SF)
    assert ok, note


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 200
    assert df.agg({"rank": "sum"}).first()[0] == 1188467
