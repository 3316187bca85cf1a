"""Named queries over the test tables."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

MODULES = ("profile_queries", "clean_queries", "score_queries", "model_queries", "edge_queries")


def load_all() -> ModuleType:
    """Import every query module once and return the registry."""
    for name in MODULES:
        import_module(f"plumbline.plans.{name}")
    return import_module("plumbline.plans.registry")
