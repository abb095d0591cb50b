"""The training-data queries against their SQL, the others for rows."""

import pytest

from strandline.llm import queries
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, small_folder, name):
    assert_same(spark, small_folder, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_has_rows(spark, small_folder, name):
    assert queries.QUERIES[name](spark, small_folder).count() > 0
