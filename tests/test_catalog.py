"""Every registered query against its DuckDB counterpart on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from catalog import base  # noqa: E402
from tests.compare import compare, duck  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = base.QUERIES, base.SQL


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    totals = {r["mode"]: r["sum(value)"] for r in entry.entry(spark).groupBy("mode").sum("value").collect()}
    assert totals == {"autocrine": 94, "paracrine": 68, "juxtacrine": 30}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    why = compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
    assert why is None, why
