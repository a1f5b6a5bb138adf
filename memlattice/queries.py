"""The registered queries of the core and the SQL they are checked against."""

from __future__ import annotations

from . import event_queries, evidence_queries, memory_queries, merge_queries, relevance_queries, source_queries, text_queries
from .problem_queries import ORACLE_SQL as PROBLEM_SQL
from .problem_queries import QUERIES as PROBLEM_QUERIES

MODULES = (text_queries, memory_queries, evidence_queries, relevance_queries, merge_queries, source_queries, event_queries)

QUERIES = dict(PROBLEM_QUERIES)
ORACLE_SQL = dict(PROBLEM_SQL)
for module in MODULES:
    QUERIES |= module.REGISTRY.queries
    ORACLE_SQL |= module.REGISTRY.sql
