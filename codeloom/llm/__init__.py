"""Operators on text for training data. Nothing else in the library imports this package."""

from __future__ import annotations

import importlib
import pkgutil


def plans() -> list:
    """The modules of this package that have QUERIES and SQL."""
    names = sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("plan_"))
    return [importlib.import_module(f"{__name__}.{name}") for name in names]
