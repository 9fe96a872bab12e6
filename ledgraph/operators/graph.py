"""A replayed graph: scans, adjacency and traversals as lazy DataFrames.

The same class serves the present, snapshots of the past and filtered views.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import strictly
from . import traverse
from .ontology import Ontology


class Graph:
    def __init__(self, nodes: DataFrame, edges: DataFrame, ontology: Ontology, *, cutoff_clock: tuple[int, int] | None = None, instance_id: str | None = None):
        self.nodes, self.edges, self.ontology = nodes, edges, ontology
        self.cutoff_clock, self.instance_id = cutoff_clock, instance_id

    # -- scans --------------------------------------------------------------

    def all_nodes(self) -> DataFrame:
        return self.nodes.where("live")

    @cached_property
    def _alive(self) -> DataFrame:
        return self.nodes.where("live").select("node_id")

    def _semi(self, edges: DataFrame, *ends: str) -> DataFrame:
        for end in ends:
            edges = edges.join(self._alive.withColumnRenamed("node_id", end), end, "left_semi")
        return edges.select(self.edges.columns)

    def all_edges(self) -> DataFrame:
        """Live edges whose ends both live."""
        # sources last: grouping by them and joins on them take the rows as they are dealt out
        return self._semi(self.edges.where("live"), "target_id", "source_id")

    def get_node(self, node_id: str) -> DataFrame:
        return self.all_nodes().where(F.col("node_id") == node_id)

    def get_edge(self, edge_id: str) -> DataFrame:
        """A live edge, whether or not its ends live."""
        return self.edges.where("live").where(F.col("edge_id") == edge_id)

    def query_nodes_by_type(self, node_type: str) -> DataFrame:
        """The type and its descendants, as a literal list that reaches the scan."""
        return self.all_nodes().where(F.col("node_type").isin(self.ontology.family(node_type)))

    def query_nodes_by_subtype(self, subtype: str) -> DataFrame:
        return self.all_nodes().where(F.col("subtype") == subtype)

    def query_nodes_by_property(self, key: str, value: object) -> DataFrame:
        return self.all_nodes().where(strictly(key, value))

    def outgoing_edges(self, node_id: str) -> DataFrame:
        return self._semi(self.edges.where("live").where(F.col("source_id") == node_id), "target_id")

    def incoming_edges(self, node_id: str) -> DataFrame:
        return self._semi(self.edges.where("live").where(F.col("target_id") == node_id), "source_id")

    def neighbors(self, node_id: str) -> DataFrame:
        """Targets of outgoing edges, one for each parallel edge."""
        return self.outgoing_edges(node_id).select(F.col("target_id").alias("node_id"))

    def reverse_neighbors(self, node_id: str) -> DataFrame:
        return self.incoming_edges(node_id).select(F.col("source_id").alias("node_id"))

    # -- traversals ---------------------------------------------------------

    def bfs(self, start: str, max_depth: int | None = None, edge_type: str | None = None) -> DataFrame:
        return traverse.reach(self.nodes, self.edges.where("live"), start, max_depth=max_depth, edge_type=edge_type, schema=self.ontology).select("node_id", "depth")

    def dfs(self, start: str, max_depth: int | None = None, edge_type: str | None = None) -> DataFrame:
        """(node_id, depth, number) in the order of a depth-first walk; with ``max_depth`` a walk may miss what ``bfs`` finds."""
        return traverse.depth_first(self.nodes, self.edges.where("live"), start, max_depth=max_depth, edge_type=edge_type, schema=self.ontology)

    def shortest_path(self, start: str, end: str) -> list[str] | None:
        return traverse.shortest_path(self.nodes, self.edges.where("live"), start, end, self.ontology)

    def impact_analysis(self, node_id: str, max_depth: int | None = None) -> DataFrame:
        return traverse.reach(self.nodes, self.edges.where("live"), node_id, max_depth=max_depth, direction="in", schema=self.ontology).select("node_id", "depth")

    def subgraph(self, start: str, hops: int) -> tuple[DataFrame, DataFrame]:
        return traverse.subgraph(self.nodes, self.edges.where("live"), start, hops, self.ontology)

    def pattern_match(self, types: list[str], max_results: int | None = 1000) -> DataFrame:
        """Chains of the types: the first one with its descendants, the others exactly."""
        if not types:
            return self._alive.where("false").select(F.col("node_id").alias("n0"))
        return traverse.pattern_match(self.nodes, self.edges.where("live"), self.ontology.family(types[0]), types[1:], max_results)

    def topological_levels(self) -> DataFrame | None:
        """(node_id, level), None on a cycle; sorted by both it is a topological order."""
        found, cyclic = traverse.levels(self.nodes, self.all_edges())
        return None if cyclic else found

    def topological_sort(self) -> list[str] | None:
        found = self.topological_levels()
        return None if found is None else [r["node_id"] for r in found.orderBy("level", "node_id").toLocalIterator()]

    def has_cycle(self) -> bool:
        return traverse.levels(self.nodes, self.all_edges())[1]

    # -- others -------------------------------------------------------------

    def view(self, **filters) -> Graph:
        from .views import graph_view

        return graph_view(self, **filters)

    def create_views(self) -> None:
        """Temporary SQL views ``nodes`` and ``edges`` of what lives."""
        self.all_nodes().createOrReplaceTempView("nodes")
        self.all_edges().createOrReplaceTempView("edges")
