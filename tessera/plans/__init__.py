"""The named queries of the library."""

from tessera.plans import graph_queries, search_queries, text_queries, write_queries  # noqa: F401
from tessera.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
