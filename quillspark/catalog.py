"""All queries of the library and the SQL that states the same result."""

from __future__ import annotations

from .plans import code, search, context, events, graphs, modules, texts, work  # noqa: F401  they fill the registry
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
