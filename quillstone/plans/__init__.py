"""Registered query plans."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import QUERIES, SQL


def load():
    """All plans and SQL of this package's modules."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES, SQL
