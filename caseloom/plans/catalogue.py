"""All queries of the core and their SQL."""

from __future__ import annotations

from . import file_queries, grader_queries, problems, relational_queries, stats_queries, text_queries

MODULES = (stats_queries, text_queries, grader_queries, relational_queries, problems, file_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
