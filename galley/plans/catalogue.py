"""All registered queries; importing the plan modules fills the registry."""

from __future__ import annotations

import importlib

from galley.plans import registry

AREAS = ("corpus", "tree", "intent", "retrieval", "checks", "evaluate", "refine", "audit", "run")


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"galley.plans.{area}_queries")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: registry.full_sql(sql) for name, sql in registry.ORACLES.items()}
