"""All core queries and the SQL that should give the same rows."""

from __future__ import annotations

from importlib import import_module

#: Modules that hold QUERIES (name -> callable) and SQL (name -> text).
MODULES = ["records", "relational", "rules", "analytics", "fields", "structure", "workflow", "evidence", "disturbed", "reports"]


def _gather(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"quirestack.plans.{m}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def sql() -> dict:
    return _gather("SQL")
