"""All queries outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that hold QUERIES: name -> (function, SQL or None).
MODULES: list[str] = ["retrieval", "texts", "evaluation", "structure", "dialogue", "upkeep", "records", "models"]


def _all() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"tessera.plans.{m}").QUERIES
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
