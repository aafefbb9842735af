"""Registered queries over the driver's tables and tables derived from them."""

from . import change_queries, command_queries, graph_queries, ingest_queries, perf_queries, scan_queries, search_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
