"""All registered queries of the engine."""
from __future__ import annotations

from . import crawl_queries, dom_queries, network_queries, operation_queries, relational_queries, source_queries, text_queries, tree_queries  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
