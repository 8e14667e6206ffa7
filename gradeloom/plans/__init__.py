"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

_MODULES = ("aggregates", "entities", "grading", "mappings", "flows")


def load_all() -> None:
    """Import every module that registers queries."""
    for module in _MODULES:
        importlib.import_module(f"{__name__}.{module}")
