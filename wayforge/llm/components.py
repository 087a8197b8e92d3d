"""Connected components of an edge table: those of the road graph, in the tables of a training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wayforge.llm.common import Scratch
from wayforge.operators import graph


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: columns a, b (any orderable type). Returns (node, root) with root < node:
    every node that isn't itself the smallest of its component. Null ends and loops are ignored."""
    return graph.components(edges, scratch, lone=False)
