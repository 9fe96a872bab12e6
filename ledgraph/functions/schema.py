"""Column layouts of the engine's tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

from .values import PROPERTIES, VALUE

_OPERANDS = {
    **dict.fromkeys(["op", "node_id", "node_type", "subtype", "label", "edge_id", "edge_type", "source_id", "target_id", "entity_id", "key"], "string"),
    "value": VALUE,
    "properties": PROPERTIES,
    "schema_json": "string",
}
OPERAND_NAMES = list(_OPERANDS)
OPERANDS = ", ".join(f"{k} {v}" for k, v in _OPERANDS.items())
CHECKPOINT = f"array<struct<{', '.join(f'{k}:{v}' for k, v in _OPERANDS.items())}, physical_ms:bigint, logical:int, clock_id:string>>"
OPLOG = f"hash string, author string, clock_id string, physical_ms bigint, logical int, next array<string>, signature binary, {OPERANDS}, ckpt_ops {CHECKPOINT}"
ENTRY_NAMES = ["hash", "author", "clock_id", "physical_ms", "logical", "next", "signature", *OPERAND_NAMES, "ckpt_ops"]
NODES = f"node_id string, node_type string, subtype string, label string, properties {PROPERTIES}, live boolean"
EDGES = f"edge_id string, edge_type string, source_id string, target_id string, properties {PROPERTIES}, live boolean"
OBSERVATIONS = "source string, timestamp_ms bigint, value double, metadata map<string,string>"


@cache
def layout() -> StructType:
    """The log's schema (parsed by Spark, so only once a session is there)."""
    return StructType.fromDDL(OPLOG)
