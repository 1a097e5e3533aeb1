"""Importing this module registers every query of the folder."""

from __future__ import annotations

from marginalia.llm import queries  # noqa: F401
from marginalia.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
