"""Every registered query against its SQL counterpart, at the smallest scale."""

import pytest

import __spark_entry__ as entry_point
from checks import compare as c
from checks import frames, oracle, registry

SF = "/root/testdata/sf0.001"
# Also run with sessions cut into blocks of a few rows.
BLOCKED = ["attach_results", "result_size", "dashboard", "followed_by_tools", "signal_correction_clusters"]


@pytest.fixture(scope="module")
def con():
    return c.connect(SF)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(oracle.oracle_sql())
    assert set(registry.QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note = c.compare(spark, con, name, SF)
    assert ok, note


@pytest.mark.parametrize("name", BLOCKED)
def test_query_in_blocks_equals_sql(spark, con, name, monkeypatch):
    monkeypatch.setattr(frames, "BLOCK_ROWS", 20)
    ok, note = c.compare(spark, con, name, SF)
    assert ok, note


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() == 20
    assert df.columns == ["session_id", "tool_name", "result_size", "next_output_tokens", "ratio"]
