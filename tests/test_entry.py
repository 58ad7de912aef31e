"""The driver contract of __spark_entry__.py."""

import importlib
import os
import sys

import pytest

from tidewater.plans.registry import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def entry_module():
    sys.path.insert(0, ROOT)
    return importlib.import_module("__spark_entry__")


def test_entry_runs_on_smoke_data(spark, entry_module):
    if not os.path.isdir(entry_module.SMOKE_DIR):
        pytest.skip("driver test data not present")
    df = entry_module.entry(spark)
    assert df.columns == ["latitude", "longitude", "speed"]
    assert df.count() >= 0


def test_every_query_has_its_oracle(entry_module):
    q, o = entry_module.queries(), entry_module.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 38
    assert set(QUERIES) <= set(o)
    assert all(callable(f) for f in q.values()) and all(isinstance(s, str) and s for s in o.values())
