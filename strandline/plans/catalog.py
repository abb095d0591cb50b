"""All queries of the library, by name."""

from __future__ import annotations

from strandline.plans import contract_queries, core_queries, panel_queries

# contract_queries registers with panel_queries
assert contract_queries.query is panel_queries.query

QUERIES = panel_queries.QUERIES | core_queries.QUERIES
ORACLE = panel_queries.ORACLE | core_queries.ORACLE
FLAGSHIP = "naive_metrics"
