"""Operation buffer: raw operations as JSON lines, without clock or hash."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "op string, node_id string, node_type string, subtype string, label string, edge_id string, edge_type string, source_id string, target_id string, entity_id string, key string, value string, properties string, seq long"
DRAINABLE = frozenset({"add_node", "add_edge", "update_property", "remove_node", "remove_edge"})


class OperationBuffer:
    def __init__(self, path: str):
        self.path = path

    def _append(self, op: str, **fields: object) -> None:
        row = {"op": op, **{k: v for k, v in fields.items() if v is not None}}
        for k in ("value", "properties"):
            if k in row:
                row[k] = json.dumps(row[k], sort_keys=True)
        if op == "update_property" and "value" not in row:
            row["value"] = "null"
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row, ensure_ascii=False) + "\n")

    def add_node(self, node_id: str, node_type: str, label: str, properties: Mapping | None = None, subtype: str | None = None) -> None:
        self._append("add_node", node_id=node_id, node_type=node_type, label=label, properties=dict(properties or {}), subtype=subtype)

    def add_edge(self, edge_id: str, edge_type: str, source_id: str, target_id: str, properties: Mapping | None = None) -> None:
        self._append("add_edge", edge_id=edge_id, edge_type=edge_type, source_id=source_id, target_id=target_id, properties=dict(properties or {}))

    def update_property(self, entity_id: str, key: str, value: object) -> None:
        self._append("update_property", entity_id=entity_id, key=key, value=value)

    def remove_node(self, node_id: str) -> None:
        self._append("remove_node", node_id=node_id)

    def remove_edge(self, edge_id: str) -> None:
        self._append("remove_edge", edge_id=edge_id)

    def read_all(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            rows = [json.loads(line) for line in f if line.strip()]
        for r in rows:
            for k in ("value", "properties"):
                if k in r:
                    r[k] = json.loads(r[k])
        return rows

    def read(self, spark: SparkSession) -> DataFrame:
        """The buffered operations as a frame, blank lines skipped."""
        return spark.read.schema(SCHEMA).json(self.path).where(F.col("op").isNotNull())

    def clear(self) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)

    def __len__(self) -> int:
        return len(self.read_all())

    def drain(self, store) -> int:
        """Apply in order; stop at the first failure and keep what remains."""
        rows = self.read_all()
        done = 0
        try:
            for r in rows:
                if r["op"] not in DRAINABLE:
                    raise ValueError(f"{r['op']} can't come from a buffer")
                store.apply_raw(r)
                done += 1
        finally:
            rest = rows[done:]
            self.clear()
            for r in rest:
                self._append(**r)
        return done
