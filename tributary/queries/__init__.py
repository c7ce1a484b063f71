"""Operators bound to the given tables, with the SQL each must agree with."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("graphs", "text", "catalogue", "projects", "features", "relational")


def load():
    """``(queries, oracles)`` of all modules."""
    for name in _MODULES:
        import_module(f"tributary.queries.{name}")
    from tributary.queries import registry

    return registry.QUERIES, registry.ORACLES
