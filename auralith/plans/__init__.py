"""Registered queries of the engine's own operators, each with the SQL it is held against."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    return [importlib.import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name)]


def queries() -> dict:
    return {name: q for m in _modules() for name, q in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "ORACLE", {}).items()}
