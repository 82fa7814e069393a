"""The catalogue of registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every catalogue module and return (queries, sql)."""
    from . import registry

    for info in sorted(pkgutil.iter_modules(__path__), key=lambda i: i.name):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
    return registry.QUERIES, {name: registry.with_ctes(text) for name, text in registry.SQL.items()}
