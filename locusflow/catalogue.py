"""Registered queries of the engine, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from .plans.registry import FOUND

for _name in ("place_queries", "log_queries", "series_queries", "label_queries", "evaluation_queries", "service_queries", "learning_queries"):
    import_module(f"locusflow.plans.{_name}")

QUERIES = {name: f for name, (f, _) in FOUND.items()}
ORACLES = {name: sql for name, (_, sql) in FOUND.items() if sql}
FLAGSHIP = "nearest_eight"
