"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")

SQL = entry.oracle_sql()
RUNS = entry.queries()
SLOW = {"three_way_test"}  # covered by test_learn on a small table


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    rows, found = oracle.differences(RUNS[name](spark, FOLDER), duck, SQL[name])
    assert not found, "\n".join(found)


@pytest.mark.parametrize("name", sorted(set(RUNS) - set(SQL) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert RUNS[name](spark, FOLDER).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
