"""Registered queries of the linkage operators."""

from __future__ import annotations

from . import decisions, retrieval, workflow  # noqa: F401  they register their queries
from .base import QUERIES, SQL
from .flagship import flagship

__all__ = ["QUERIES", "SQL", "flagship"]
