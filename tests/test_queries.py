"""Registered queries against their SQL twins on the small tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(entry.queries())
#: a query that finds nothing in the smallest tables has to in these
LARGER = str(Path(SF).parent / "sf0.01")

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    run, sql = entry.queries()[name], entry.oracle_sql().get(name)
    ok, message, rows, _ = compare(spark, duck(SF), run, sql, SF)
    if rows == 0 and message in ("EMPTY", "rows only"):
        ok, message, rows, _ = compare(spark, duck(LARGER), run, sql, LARGER)
    assert ok and rows > 0, message


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    if Path("/root/testdata/sf0.001").exists():
        assert entry.entry(spark).columns == ["site_id", "n_obs", "a0", "p1", "p1_std", "chi2_red"]
