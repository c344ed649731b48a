"""All queries of the engine's own operators, by name, and their SQL oracles."""

from __future__ import annotations

from .plans import code_queries, queries  # noqa: F401
from .plans.registered import ORACLES, QUERIES

FLAGSHIP = "search_documents"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
