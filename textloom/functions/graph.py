"""Ids, weights and codes of graph rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import clamp


def md5_id(prefix: str, c: Column) -> Column:
    """A reproducible id; no salt, no modulus."""
    return F.concat(F.lit(prefix), F.substring(F.md5(c), 1, 16))


def edge_id(kind: str, a: Column, b: Column) -> Column:
    return F.concat_ws("_", F.lit(kind), a.cast("string"), b.cast("string"))


def edge_weight(edge_type: Column, w: Column) -> Column:
    """similarity in [0, 1], relevance at least 0, hierarchical 1, co-occurrence as it is."""
    return F.when(edge_type == "similarity", clamp(w, 0.0, 1.0)).when(edge_type == "relevance", F.greatest(w, F.lit(0.0))).when(edge_type == "hierarchical", F.lit(1.0)).otherwise(w)


def group_code(node_type: Column) -> Column:
    return F.when(node_type == "document", 1).when(node_type == "section", 2).when(node_type == "entity", 3).when(node_type == "concept", 4).otherwise(0)
