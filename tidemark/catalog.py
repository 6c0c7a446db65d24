"""Queries of the library's own operators and their DuckDB SQL."""

from __future__ import annotations

from .plans import events, filling, growth, learning, models, registry, relations, tables  # noqa: F401

QUERIES = registry.QUERIES
ORACLE_SQL = registry.SQL
FLAGSHIP = "hourly_rate_filled"
