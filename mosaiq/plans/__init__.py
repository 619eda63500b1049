"""Registered queries over the test schema and their DuckDB equivalents."""

from __future__ import annotations

from .registry import oracle_sql, queries
from . import analysis, assays, rasters  # noqa: F401, E402  each registers its queries

__all__ = ["oracle_sql", "queries"]
