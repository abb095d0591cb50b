"""Every core query with SQL against DuckDB, the others for rows and schema."""

import pytest

from strandline.plans import catalog
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, small_folder, name):
    assert_same(spark, small_folder, catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE) - {"arima_search", "arima_walk_forward_daily"}))
def test_query_without_sql_runs(spark, small_folder, name):
    frame = catalog.QUERIES[name](spark, small_folder)
    assert frame.columns
    frame.collect()


def test_entry_points(spark, small_folder):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
