"""A fluent query over any graph; every step adds to one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import decode, loosely
from .graph import Graph


class QueryEngine(Protocol):
    def execute(self, graph: Graph, text: str) -> DataFrame: ...


class SqlEngine:
    """Spark SQL over the views ``nodes`` and ``edges``."""

    def execute(self, graph: Graph, text: str) -> DataFrame:
        graph.create_views()
        return graph.nodes.sparkSession.sql(text)


def to_dict(row) -> dict:
    """A node or edge row as a plain dict with decoded properties."""
    out = {k: v for k, v in row.asDict().items() if k not in ("property_clocks", "add_clock", "live")}
    out["properties"] = {k: decode(v) for k, v in (row["properties"] or {}).items()}
    return out


def python_filter(df: DataFrame, predicate: Callable[[dict], bool]) -> DataFrame:
    """Rows for which a Python predicate holds; the slow way, in Arrow batches."""
    names = [c for c in df.columns if c not in ("property_clocks", "add_clock")]

    @F.pandas_udf("boolean")
    def holds(rows: pd.DataFrame) -> pd.Series:
        out = []
        for row in rows.to_dict("records"):
            props = row.get("properties")
            row["properties"] = {k: decode(v) for k, v in (dict(props) if props is not None else {}).items()}
            out.append(bool(predicate(row)))
        return pd.Series(out, dtype=bool)

    return df.where(holds(F.struct(*names)))


class Query:
    def __init__(self, graph: Graph, engine: QueryEngine | None = None):
        self.graph, self.engine = graph, engine
        self._df: DataFrame | None = None
        self._kind = ""

    def _with(self, df: DataFrame, kind: str | None = None) -> Query:
        out = Query(self.graph, self.engine)
        out._df, out._kind = df, kind or self._kind
        return out

    def nodes(self, node_type: str | None = None, subtype: str | None = None) -> Query:
        df = self.graph.query_nodes_by_type(node_type) if node_type else self.graph.all_nodes()
        return self._with(df.where(F.col("subtype") == subtype) if subtype else df, "node")

    def edges(self, edge_type: str | None = None) -> Query:
        df = self.graph.all_edges()
        return self._with(df.where(F.col("edge_type") == edge_type) if edge_type else df, "edge")

    def _set(self) -> DataFrame:
        if self._df is None:
            raise RuntimeError("start with nodes() or edges()")
        return self._df

    def where(self, **properties: object) -> Query:
        df = self._set()
        for key, value in properties.items():
            df = df.where(loosely(key, value))
        return self._with(df)

    def where_fn(self, predicate: Column | Callable) -> Query:
        """A Column, or a Python predicate over row dicts (slow)."""
        df = self._set()
        return self._with(df.where(predicate) if isinstance(predicate, Column) else python_filter(df, predicate))

    def follow(self, edge_type: str | None = None, direction: str = "out") -> Query:
        """The distinct live neighbours of the set; a set of edges has none."""
        df = self._set()
        live = self.graph.all_nodes()
        if self._kind != "node" or direction not in ("out", "in", "both"):
            return self._with(live.where("false"), "node")
        edges = self.graph.edges.where("live")
        if edge_type:
            edges = edges.where(F.col("edge_type") == edge_type)
        # the schema says where edges lead: a literal list, which prunes scans of other types
        schema = self.graph.ontology
        kinds = [edge_type] if edge_type else list(schema.edge_types)
        if all(k in schema.edge_types for k in kinds):
            live = live.where(F.col("node_type").isin(schema.node_types_at(kinds, direction)))
        ids = df.select("node_id")
        ends = [("source_id", "target_id")] * (direction != "in") + [("target_id", "source_id")] * (direction != "out")
        reached: DataFrame | None = None
        for near, far in ends:
            step = edges.join(ids.withColumnRenamed("node_id", near), near, "left_semi").select(F.col(far).alias("node_id"))
            reached = step if reached is None else reached.unionByName(step)
        # distinct ids are few where many edges lead to few nodes; a semi-join takes each neighbour once
        return self._with(live.join(reached.distinct(), "node_id", "left_semi"), "node")

    def limit(self, n: int) -> Query:
        """The n smallest by id."""
        return self._with(self._set().orderBy(f"{self._kind}_id").limit(n))

    def raw(self, text: str) -> DataFrame:
        if self.engine is None:
            raise RuntimeError("no query engine")
        return self.engine.execute(self.graph, text)

    def to_df(self) -> DataFrame:
        return self._set()

    def collect(self) -> list[dict]:
        return [] if self._df is None else [to_dict(r) for r in self._df.collect()]

    def collect_ids(self) -> list[str]:
        return [] if self._df is None else [r[0] for r in self._df.select(f"{self._kind}_id").collect()]

    def count(self) -> int:
        return 0 if self._df is None else self._df.count()

    def first(self) -> dict | None:
        row = None if self._df is None else self._df.orderBy(f"{self._kind}_id").first()
        return None if row is None else to_dict(row)

    __len__ = count

    def __iter__(self) -> Iterator[dict]:
        return iter(self.collect())
