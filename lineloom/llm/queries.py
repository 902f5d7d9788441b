"""The registered queries of this subpackage and their SQL, by operator."""

from __future__ import annotations

import importlib

#: Modules of queries; each has QUERIES and ORACLE_SQL.
MODULES = ("query_op1", "query_op2", "query_op3", "query_op4", "query_op5", "query_op6", "query_op7", "query_op8", "query_op9", "query_op10")


def _each(attribute: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"lineloom.llm.{m}"), attribute)
    return out


def queries() -> dict:
    return _each("QUERIES")


def oracle_sql() -> dict:
    return _each("ORACLE_SQL")
