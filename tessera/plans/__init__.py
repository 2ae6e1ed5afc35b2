"""The queries of the operators over the standard tables, and the same results as SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and ORACLE.
MODULES = ("search", "ingest", "state", "graph", "activity", "extra", "service")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").ORACLE.items()}
