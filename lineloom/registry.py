"""The engine's own registered queries and their SQL, by module."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> function of session and folder) and ORACLE_SQL (name -> DuckDB SQL).
MODULES: tuple[str, ...] = ("text_queries", "recognition_queries", "relation_queries", "configuration_queries")


def _each(attribute: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"lineloom.plans.{m}"), attribute)
    return out


def queries() -> dict:
    return _each("QUERIES")


def oracle_sql() -> dict:
    return _each("ORACLE_SQL")
