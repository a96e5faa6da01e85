"""Registered queries and, where SQL can express them, the DuckDB text with the same rows."""

from __future__ import annotations

from . import corpusqueries, morequeries, postqueries, renderqueries, textqueries, trainqueries

_MODULES = (textqueries, corpusqueries, postqueries, morequeries, renderqueries, trainqueries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
