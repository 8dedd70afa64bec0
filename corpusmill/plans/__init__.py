"""Queries over the test tables and their DuckDB twins."""

from . import catalogue, dedup, events, knowledge, retrieval, scopes, tables, texts

_MODULES = (retrieval, dedup, catalogue, events, texts, knowledge, scopes, tables)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
