"""All queries of the library but those of its optional subpackage."""

from __future__ import annotations

from .plans import engine_corpus, functions_corpus, relational, tpch  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
