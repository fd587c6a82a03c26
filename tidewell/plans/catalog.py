"""All queries of the library outside the training-data package."""

from __future__ import annotations

import importlib

from tidewell.plans.registry import ORACLES, QUERIES

MODULES = ("sources", "relational", "retrieval", "text", "lifecycle", "triage", "turns", "evaluation", "streams")

for _name in MODULES:
    importlib.import_module(f"tidewell.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
