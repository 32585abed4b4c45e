"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from compare import compare, connect  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, name, queries()[name], oracle_sql().get(name), SF) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(oracle_sql()) <= set(queries())
