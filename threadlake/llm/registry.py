"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from importlib import import_module

NAMES = ("splitting", "languages", "clustering", "percentiles", "encoding", "leakage", "subjects")


def _modules():
    return [import_module(f"threadlake.llm.{n}") for n in NAMES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.oracle_sql().items()}
