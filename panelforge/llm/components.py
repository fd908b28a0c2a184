"""Connected components of an edge table, each round's tables stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph
from .common import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of edges (a, b) can reach."""
    return graph.components(edges, stored, rounds)
