"""Registered queries over the analytics tables."""

from __future__ import annotations

import importlib

MODULES = ["literature", "evidence", "synthesis", "evaluation", "living", "structure", "projections"]


def load():
    """(queries, oracle SQL) of every plan module."""
    from evloom.plans import registry
    for name in MODULES:
        importlib.import_module(f"evloom.plans.{name}")
    return registry.QUERIES, registry.ORACLES
