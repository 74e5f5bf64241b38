"""Queries over the shared tables, one module for each family of operators."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package, so that all queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
