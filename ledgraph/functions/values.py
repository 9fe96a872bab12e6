"""Property values: a kind and a canonical JSON literal.

Kinds are null, bool, int, float, string, list and map.  Int and float never
coerce in strict equality; ``loosely`` compares as Python does (1 == 1.0 == True).
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<kind:string,lit:string>"
PROPERTIES = f"map<string,{VALUE}>"

# Limits on input, fixed values.
MAX_DEPTH = 64
MAX_STRING_BYTES = 1 << 20
MAX_LIST_ITEMS = 10_000
MAX_MAP_ENTRIES = 10_000


def kind_of(value: object, depth: int = 0) -> str:
    if depth > MAX_DEPTH:
        raise ValueError(f"value is nested deeper than {MAX_DEPTH}")
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise ValueError("integer does not fit 64 bits")
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        if len(value.encode()) > MAX_STRING_BYTES:
            raise ValueError("string is too long")
        return "string"
    if isinstance(value, list | tuple):
        if len(value) > MAX_LIST_ITEMS:
            raise ValueError("list has too many items")
        for v in value:
            kind_of(v, depth + 1)
        return "list"
    if isinstance(value, Mapping):
        if len(value) > MAX_MAP_ENTRIES:
            raise ValueError("map has too many entries")
        for k, v in value.items():
            if not isinstance(k, str):
                raise TypeError("map keys are strings")
            kind_of(v, depth + 1)
        return "map"
    raise TypeError(f"unsupported value type {type(value).__name__}")


def encode(value: object) -> dict[str, str]:
    kind = kind_of(value)
    text = value if kind == "string" else "null" if kind == "null" else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {"kind": kind, "lit": text}


def decode(value) -> object:
    """A Python value from a (kind, lit) row or dict."""
    if value is None:
        return None
    kind, text = value["kind"], value["lit"]
    if kind == "null":
        return None
    if kind == "string":
        return text
    return float(text) if kind == "float" else json.loads(text)


def encode_all(properties: Mapping[str, object] | None) -> dict[str, dict[str, str]]:
    return {k: encode(v) for k, v in (properties or {}).items()}


def literal(value: object) -> Column:
    e = encode(value)
    return F.struct(F.lit(e["kind"]).alias("kind"), F.lit(e["lit"]).alias("lit"))


def of_column(column: Column, kind: str) -> Column:
    """A value of one kind from a typed column; null gives kind null."""
    text = column.cast("double").cast("string") if kind == "float" else column.cast("string")
    return F.when(column.isNull(), F.struct(F.lit("null").alias("kind"), F.lit("null").alias("lit"))).otherwise(F.struct(F.lit(kind).alias("kind"), text.alias("lit")))


def prop(name: str, kind: str, properties: str | Column = "properties") -> Column:
    """A property as a typed column; null where it is absent or of another kind."""
    value = (F.col(properties) if isinstance(properties, str) else properties)[name]
    cast = {"int": "bigint", "float": "double", "bool": "boolean", "string": "string"}.get(kind, "string")
    return F.when(value["kind"] == kind, value["lit"].cast(cast))


def strictly(name: str, value: object, properties: str = "properties") -> Column:
    """Typed equality; a missing key never matches, an explicit null matches null."""
    found = F.col(properties)[name]
    e = encode(value)
    same = found["kind"] == e["kind"]
    if e["kind"] == "float":
        same = same & (found["lit"].try_cast("double") == float(value))
    elif e["kind"] != "null":
        same = same & (found["lit"] == e["lit"])
    return F.coalesce(same, F.lit(False))


def loosely(name: str, value: object, properties: str = "properties") -> Column:
    """Equality as in Python: numbers and booleans by value, a missing key equals None."""
    found = F.col(properties)[name]
    if value is None:
        return found.isNull() | (found["kind"] == "null")
    if isinstance(value, bool | int | float):
        number = F.when(found["kind"].isin("int", "float"), found["lit"].try_cast("double")).when(found["kind"] == "bool", F.when(found["lit"] == "true", 1.0).otherwise(0.0))
        same = number == float(value)
        if isinstance(value, int) and not isinstance(value, bool):
            same = F.when(found["kind"] == "int", found["lit"] == str(value)).otherwise(same)
        return F.coalesce(same, F.lit(False))
    e = encode(value)
    return F.coalesce((found["kind"] == e["kind"]) & (found["lit"] == e["lit"]), F.lit(False))
