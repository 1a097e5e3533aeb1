"""Importing this module registers every query."""

from __future__ import annotations

from marginalia.plans import curation, logs, markup, scores  # noqa: F401
from marginalia.plans import registry

QUERIES = registry.QUERIES
ORACLE = {name: registry.with_shared(sql) for name, sql in registry.ORACLE.items()}

__all__ = ["ORACLE", "QUERIES"]
