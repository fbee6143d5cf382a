from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry_module  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["unit_id", "lag_rate", "lag_gap_to_parent"] and df.limit(1).count() == 1


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql_twin(spark, con, name):
    assert compare(spark, con, name, entry_module.queries()[name], ORACLES[name], SF).startswith("ok")
