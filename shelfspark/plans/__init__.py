"""Registered queries over the given tables, with equivalent SQL."""

from __future__ import annotations

from . import build_queries, extract_queries, search_queries

_ALL = search_queries.QUERIES | extract_queries.QUERIES | build_queries.QUERIES

QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
