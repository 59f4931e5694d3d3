"""All registered queries."""

from . import concept_queries, graph_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "concept_queries", "graph_queries", "text_queries"]
