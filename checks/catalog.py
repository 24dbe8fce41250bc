"""Load every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["marts", "basics", "joins_aggs", "windows", "quality", "feature_sets", "statistics", "evaluation", "recommendation", "models"]


def load():
    for module in MODULES:
        import_module(f"checks.{module}")
    from checks.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
