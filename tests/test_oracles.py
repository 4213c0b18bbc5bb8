"""Every registered query against its SQL form on DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import compare, database
from cytoplane.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(tiny):
    return database(tiny)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, con, tiny, name):
    status, _seconds, note = compare(spark, con, name, tiny, limit=180)
    # Some queries select nothing from the smallest tables; there both sides must agree on that.
    assert status in ("ok", "EMPTY", "rows-only"), note


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) >= 107
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["gene", "fg", "bg", "marker_group", "fg_start", "fg_end", "bg_end", "is_control"]
    assert df.count() > 0
