"""All queries of the engine by name, with the SQL each is held against."""

from __future__ import annotations

from . import census_queries, relational_queries, report_queries, series_queries, source_queries, text_queries

MODULES = (series_queries, relational_queries, text_queries, report_queries, census_queries, source_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
