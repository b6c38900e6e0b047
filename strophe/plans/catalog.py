"""Every registered query of the reference's operators, with its SQL where SQL can express it."""

from __future__ import annotations

from strophe.plans import parse_queries, quality_queries, search_queries, store_queries, text_queries

_MODULES = (text_queries, parse_queries, store_queries, quality_queries, search_queries)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: query for m in _MODULES for name, query in m.ORACLE_SQL.items()}
