"""Filtered views: a graph of the nodes that pass, and the edges between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .graph import Graph


def graph_view(graph: Graph, node_types: Sequence[str] | None = None, subtypes: Sequence[str] | None = None, predicate: Column | Callable | None = None) -> Graph:
    """Types match exactly; an empty list is no filter; a predicate is a Column or a function of a node row (a dict)."""
    nodes = graph.all_nodes()
    if node_types:
        nodes = nodes.where(F.col("node_type").isin(list(node_types)))
    if subtypes:
        nodes = nodes.where(F.col("subtype").isin(list(subtypes)))
    if isinstance(predicate, Column):
        nodes = nodes.where(predicate)
    elif predicate is not None:
        from .query import python_filter

        nodes = python_filter(nodes, predicate)
    ids = nodes.select("node_id")
    edges = graph.edges.where("live")
    schema = graph.ontology
    if node_types and all(t in schema.node_types for t in node_types):
        # the schema says which edges can have both ends among the types: a literal list, which prunes scans of others
        into = set(schema.edge_types_at(list(node_types), "in"))
        edges = edges.where(F.col("edge_type").isin([t for t in schema.edge_types_at(list(node_types), "out") if t in into]))
    for end in ("target_id", "source_id"):
        edges = edges.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
    return Graph(nodes, edges.select(graph.edges.columns), graph.ontology, cutoff_clock=graph.cutoff_clock, instance_id=graph.instance_id)
