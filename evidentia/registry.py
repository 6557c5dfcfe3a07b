"""Queries and their SQL by name."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("text_queries", "geometry_queries", "retrieval_queries", "ledger_queries", "evaluation_queries", "operations_queries")
_ALL = {k: v for m in _MODULES for k, v in import_module(f"evidentia.plans.{m}").QUERIES.items()}

QUERIES = {k: q for k, (q, _) in _ALL.items()}
SQL = {k: s for k, (_, s) in _ALL.items() if s}
