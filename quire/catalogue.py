"""The engine's own queries and the SQL that they are held against."""

from __future__ import annotations

from quire.plans import reference_queries, structure_queries, text_queries  # noqa: F401  (they register themselves)
from quire.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
