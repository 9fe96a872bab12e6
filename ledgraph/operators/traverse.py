"""Traversals as frontier loops over edge DataFrames.

Each hop is a join of the frontier with the edges and an anti-join with what has
been visited; what a hop adds is written to the shared folder, so lineage stays
short and the planner knows the frontier's size.  Frontiers and visited sets are DataFrames throughout; only counts come to
the driver.  Shallow, fixed shapes (typed chains) are single plans of joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written
from .ontology import Ontology


def _arcs(edges: DataFrame, direction: str, edge_type: str | None) -> DataFrame:
    if edge_type is not None:
        edges = edges.where(F.col("edge_type") == edge_type)
    out = edges.select(F.col("source_id").alias("from"), F.col("target_id").alias("to"))
    back = edges.select(F.col("target_id").alias("from"), F.col("source_id").alias("to"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


LAZY_HOPS = 4
"""Hops that read the edges where they are; longer walks write what is left of them once."""


def reach(nodes: DataFrame, edges: DataFrame, start: str, *, max_depth: int | None = None, edge_type: str | None = None, direction: str = "out", until: str | None = None, schema: Ontology | None = None) -> DataFrame:
    """(node_id, depth, parent) of all live nodes within reach; empty if the start is missing.  Ties of parents: the smallest.

    A hop joins the frontier with the edges, and only what it reaches with the nodes.  With a schema, the
    frontier's types tell which edge and node types a hop can meet, as literal lists that prune the scans.
    """
    alive = nodes.where("live").select("node_id", "node_type")
    first = alive.where(F.col("node_id") == start).select("node_id", "node_type", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    seen = frontier = written(first, "frontier")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        some, targets = edges, alive
        if schema is not None:
            kinds = [r[0] for r in frontier.select("node_type").distinct().collect()]  # no more than the schema has
            known = schema.edge_types_at(kinds, direction) if all(k in schema.node_types for k in kinds) else list(schema.edge_types)
            known = [k for k in known if edge_type in (None, k)]
            if not known:
                break
            if len(known) < len(schema.edge_types):
                some = edges.where(F.col("edge_type").isin(known))
            targets = alive.where(F.col("node_type").isin(schema.node_types_at(known, direction)))
        if depth == LAZY_HOPS + 1:
            edges = some = written(edges.select("edge_type", "source_id", "target_id") if edge_type is None else edges.where(F.col("edge_type") == edge_type).select("edge_type", "source_id", "target_id"), "arcs")
        arcs = _arcs(some, direction, edge_type)
        step = arcs.join(frontier.select(F.col("node_id").alias("from")), "from").groupBy(F.col("to").alias("node_id")).agg(F.min("from").alias("parent"))
        step = written(step.join(seen.select("node_id"), "node_id", "left_anti"), "step")
        frontier = written(targets.join(step, "node_id").select("node_id", "node_type", F.lit(depth).alias("depth"), "parent"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if until is not None and not frontier.where(F.col("node_id") == until).isEmpty():
            break
    return seen.select("node_id", "depth", "parent")


def depth_first(nodes: DataFrame, edges: DataFrame, start: str, *, max_depth: int | None = None, edge_type: str | None = None, schema: Ontology | None = None) -> DataFrame:
    """(node_id, depth, number) of a depth-first walk; of siblings the greatest id goes first, nodes are taken when they are pushed.

    The walk is sequential by definition: what ``reach`` finds is gathered as pairs of ids in one task.
    Ask ``reach`` for the set alone.
    """
    found = written(reach(nodes, edges, start, max_depth=max_depth, edge_type=edge_type, schema=schema).select("node_id"), "reached")
    arcs = _arcs(edges, "out", edge_type).join(found.select(F.col("node_id").alias("from")), "from", "left_semi").join(found.select(F.col("node_id").alias("to")), "to", "left_semi")
    rows = arcs.select("from", "to").distinct().unionByName(found.where(F.col("node_id") == start).select(F.lit(None).cast("string").alias("from"), F.col("node_id").alias("to")))

    def walk(pairs: pd.DataFrame) -> pd.DataFrame:
        targets: dict[str, list[str]] = {}
        for a, b in zip(pairs["from"], pairs["to"], strict=True):
            if a is not None:
                targets.setdefault(a, []).append(b)
        seen, stack, out = {start}, [(start, 0)], []
        while stack:
            at, depth = stack.pop()
            out.append((at, depth))
            if max_depth is not None and depth >= max_depth:
                continue
            for b in sorted(targets.get(at, ())):
                if b not in seen:
                    seen.add(b)
                    stack.append((b, depth + 1))
        return pd.DataFrame({"node_id": [x for x, _ in out], "depth": [d for _, d in out], "number": range(len(out))})

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(walk, "node_id string, depth int, number long")


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, end: str, schema: Ontology | None = None) -> list[str] | None:
    """Node ids of a shortest directed path, or None; of equal ones that with the smallest parents, walked back from the end."""
    found = reach(nodes, edges, start, until=end, schema=schema)
    if start == end:
        return [start] if not found.isEmpty() else None
    at = found.where(F.col("node_id") == end).first()
    if at is None:
        return None
    path = [end]
    while at["parent"] is not None:  # one lookup for each hop of the path
        path.append(at["parent"])
        at = found.where(F.col("node_id") == at["parent"]).first()
    return path[::-1]


def subgraph(nodes: DataFrame, edges: DataFrame, start: str, hops: int, schema: Ontology | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` in either direction, and the edges that touch a node nearer than ``hops``."""
    found = reach(nodes, edges, start, max_depth=hops, direction="both", schema=schema)
    inner = found.where(F.col("depth") < hops).select("node_id")
    # both ends of such an edge are within reach, if they live
    ends = found.select("node_id")
    touched = [edges.join(inner.withColumnRenamed("node_id", near), near, "left_semi").join(ends.withColumnRenamed("node_id", far), far, "left_semi").select(edges.columns) for near, far in (("source_id", "target_id"), ("target_id", "source_id"))]
    touched = touched[0].unionByName(touched[1])
    return found.select("node_id", "depth"), touched.dropDuplicates(["edge_id"])


def pattern_match(nodes: DataFrame, edges: DataFrame, first: list[str], rest: list[str], max_results: int | None = 1000) -> DataFrame:
    """(n0, n1, ...) of directed chains of nodes of the given types without repeats; parallel edges give repeated chains."""
    live = nodes.where("live").select("node_id", "node_type")
    out = live.where(F.col("node_type").isin(first)).select(F.col("node_id").alias("n0"))
    arcs = edges.select("source_id", "target_id")
    for i, kind in enumerate(rest, 1):
        ends = live.where(F.col("node_type") == kind).select(F.col("node_id").alias(f"n{i}"))
        steps = arcs.join(ends, F.col("target_id") == F.col(f"n{i}")).select(F.col("source_id").alias(f"n{i - 1}"), f"n{i}")
        out = out.join(steps, f"n{i - 1}").where(~F.col(f"n{i}").isin(*(F.col(f"n{j}") for j in range(i))))
    out = out.select(*(f"n{i}" for i in range(len(rest) + 1)))
    return out if max_results is None else out.orderBy(*out.columns).limit(max_results)


def levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """(node_id, level) by peeling nodes without open predecessors, and whether a cycle remained."""
    left = written(nodes.where("live").select("node_id"), "left")
    arcs = written(edges.select("source_id", "target_id").distinct(), "arcs")
    out: DataFrame | None = None
    level = 0
    while True:
        free = left.join(arcs.select(F.col("target_id").alias("node_id")).distinct(), "node_id", "left_anti")
        free = written(free.withColumn("level", F.lit(level)), "level")
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        left = written(left.join(free, "node_id", "left_anti"), "left")
        arcs = written(arcs.join(free.select(F.col("node_id").alias("source_id")), "source_id", "left_anti"), "arcs")
        level += 1
    empty = nodes.sparkSession.createDataFrame([], "node_id string, level int")
    return (empty if out is None else out), not left.isEmpty()


def ancestors(links: DataFrame, heads: DataFrame) -> DataFrame:
    """(hash) of all entries that the heads reach over (hash, parent) links, heads included.

    Only entries that others build on are walked: heads without children, however many, take one step.
    Links are doubled each round, so a chain takes as many rounds as its length has binary digits.
    """
    links, heads = written(links.select("hash", "parent"), "links"), written(heads.select("hash").distinct(), "heads")
    parents = written(links.select(F.col("parent").alias("hash")).distinct(), "parents")
    jump = written(links.join(parents, "hash", "left_semi").distinct(), "jumps")
    seen = written(links.join(heads, "hash", "left_semi").select(F.col("parent").alias("hash")).distinct(), "closure")
    while True:
        # what is seen so far are the ancestors nearer than one jump
        step = written(seen.join(jump, "hash").select(F.col("parent").alias("hash")).distinct().join(seen, "hash", "left_anti"), "closure")
        if step.isEmpty():
            return heads.unionByName(seen).distinct()
        seen = written(seen.unionByName(step), "closure")
        jump = written(jump.join(jump.select(F.col("hash").alias("parent"), F.col("parent").alias("far")), "parent").select("hash", F.col("far").alias("parent")).distinct(), "jumps")
