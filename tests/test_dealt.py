"""Tasks over whole runs grow in number with the rows, not in size."""

import os

import pytest

from pathloom.operators import alignment, joins
from pathloom.plans import kernel_queries

SF = os.environ.get("PATHLOOM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def small(monkeypatch):
    for module in (joins, alignment):
        monkeypatch.setattr(module, "ROWS_A_TASK", 20, raising=False)


def test_walks_are_dealt_by_their_rows(spark, small):
    walk = kernel_queries._walk(spark, SF)
    assert walk.rdd.getNumPartitions() == -(-walk.count() // 20) == 50


def test_fused_rows_are_dealt_by_their_rows(spark, small):
    walk = kernel_queries._walk(spark, SF).select("run", "id", "t", "x", "y")
    rows, _ = alignment.fused(walk, walk.filter("id % 2 = 0"), "run", "t", "id")
    assert rows.rdd.getNumPartitions() > 50 and rows.count() > 900
