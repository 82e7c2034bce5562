"""Queries by name, with the SQL that expresses them."""

from __future__ import annotations

from . import data_queries, graph_queries, more_queries, patch_queries, spectral_queries

MODULES = (graph_queries, patch_queries, data_queries, more_queries, spectral_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.SQL.items()}
