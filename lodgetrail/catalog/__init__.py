"""Registered queries over the driver tables, each with its SQL twin."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

_PARTS = (
    "tracking", "sources", "sinks", "predicates", "joins", "aggregates", "windows", "orders",
    "sets", "scalars", "serving", "streams",
)


def load() -> ModuleType:
    """Import every part once and return the registry."""
    for part in _PARTS:
        import_module(f"lodgetrail.catalog.{part}")
    return import_module("lodgetrail.catalog.registry")
