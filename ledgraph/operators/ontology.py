"""Declared graph schemas: checks, hierarchy, additive evolution, comparison, and validators as Columns.

A schema is a floor: undeclared types are rejected, undeclared properties and
subtypes are accepted.  It is small and lives on the driver; what judges rows is
compiled to Column expressions, so validation stays inside generated code.
"""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("string", "int", "float", "bool", "list", "map", "any")
CONSTRAINTS = ("enum", "min", "max", "min_exclusive", "max_exclusive", "min_length", "max_length", "pattern")
MAX_ANCESTORS = 100


class OntologyError(ValueError):
    """A schema, or an extension of one, that can't be accepted."""


def enforced_constraint_names() -> list[str]:
    return sorted(CONSTRAINTS)


def _property(spec: object) -> dict:
    if isinstance(spec, str):
        spec = {"value_type": spec}
    out = {"value_type": spec.get("value_type", "any"), "required": bool(spec.get("required", False)), "constraints": dict(spec.get("constraints") or {})}
    if out["value_type"] not in KINDS:
        raise OntologyError(f"unknown value type {out['value_type']!r}")
    if spec.get("description"):
        out["description"] = spec["description"]
    return out


def _properties(spec: Mapping | None) -> dict[str, dict]:
    return {k: _property(v) for k, v in sorted((spec or {}).items())}


def _node_type(spec: Mapping) -> dict:
    return {
        "properties": _properties(spec.get("properties")),
        "subtypes": {k: {"properties": _properties(v.get("properties"))} for k, v in sorted((spec.get("subtypes") or {}).items())},
        "parent_type": spec.get("parent_type"),
    }


def _edge_type(spec: Mapping) -> dict:
    return {"source_types": list(spec["source_types"]), "target_types": list(spec["target_types"]), "properties": _properties(spec.get("properties"))}


class Ontology:
    def __init__(self, spec: str | Mapping):
        if isinstance(spec, str):
            spec = json.loads(spec)
        if not isinstance(spec, Mapping):
            raise TypeError("an ontology is a mapping or JSON text")
        self.node_types: dict[str, dict] = {k: _node_type(v) for k, v in sorted((spec.get("node_types") or {}).items())}
        self.edge_types: dict[str, dict] = {k: _edge_type(v) for k, v in sorted((spec.get("edge_types") or {}).items())}
        self.check()

    # -- form ---------------------------------------------------------------

    def to_dict(self) -> dict:
        return copy.deepcopy({"node_types": self.node_types, "edge_types": self.edge_types})

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":"))

    def digest(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def check(self) -> None:
        """Endpoint and parent types exist, the hierarchy has no cycle, constraints have known names or start with x_."""
        for name, t in self.node_types.items():
            parent = t["parent_type"]
            if parent is not None and parent not in self.node_types:
                raise OntologyError(f"node type {name!r} has unknown parent {parent!r}")
            if name in self.ancestors(name):
                raise OntologyError(f"node type {name!r} is its own ancestor")
        for name, e in self.edge_types.items():
            for end in (*e["source_types"], *e["target_types"]):
                if end not in self.node_types:
                    raise OntologyError(f"edge type {name!r} refers to unknown node type {end!r}")
        for where, props in self._all_properties():
            for prop, p in props.items():
                for c in p["constraints"]:
                    if c not in CONSTRAINTS and not c.startswith("x_"):
                        raise OntologyError(f"{where}.{prop} has unknown constraint {c!r}")

    def _all_properties(self) -> Iterable[tuple[str, dict]]:
        for name, t in self.node_types.items():
            yield name, t["properties"]
            for sub, s in t["subtypes"].items():
                yield f"{name}/{sub}", s["properties"]
        for name, e in self.edge_types.items():
            yield name, e["properties"]

    # -- hierarchy ----------------------------------------------------------

    def ancestors(self, name: str) -> list[str]:
        out: list[str] = []
        at = self.node_types.get(name, {}).get("parent_type")
        while at is not None and len(out) < MAX_ANCESTORS:
            out.append(at)
            at = self.node_types.get(at, {}).get("parent_type")
        return out

    def descendants(self, name: str) -> list[str]:
        return sorted(t for t in self.node_types if name in self.ancestors(t))

    def is_a(self, name: str, ancestor: str) -> bool:
        return name == ancestor or ancestor in self.ancestors(name)

    def family(self, name: str) -> list[str]:
        """The type and its descendants; empty for an unknown type."""
        return sorted([name, *self.descendants(name)]) if name in self.node_types else []

    def edge_types_at(self, node_types: Iterable[str], direction: str = "out") -> list[str]:
        """Edge types that may start ("out"), end ("in") or do either ("both") at nodes of these types."""
        kinds, sides = set(node_types), {"out": ("source_types",), "in": ("target_types",)}.get(direction, ("source_types", "target_types"))
        return [e for e, spec in self.edge_types.items() if any(not kinds.isdisjoint(self.family(t)) for side in sides for t in spec[side])]

    def node_types_at(self, edge_types: Iterable[str], direction: str = "out") -> list[str]:
        """Node types that these edge types may lead to."""
        sides = {"out": ("target_types",), "in": ("source_types",)}.get(direction, ("source_types", "target_types"))
        return sorted({f for e in edge_types for side in sides for t in self.edge_types[e][side] for f in self.family(t)})

    def effective_properties(self, name: str) -> dict[str, dict]:
        out: dict[str, dict] = {}
        for t in [*reversed(self.ancestors(name)), name]:
            out |= self.node_types[t]["properties"]
        return out

    # -- evolution ----------------------------------------------------------

    def extended(self, extension: str | Mapping) -> Ontology:
        """A copy with an additive extension merged in; raises without a trace if any part is refused."""
        if isinstance(extension, str):
            extension = json.loads(extension)
        known = {"node_types", "edge_types", "node_type_updates", "edge_type_updates"}
        if extra := set(extension) - known:
            raise OntologyError(f"unknown extension keys {sorted(extra)}")
        if not any(extension.get(k) for k in known):
            raise OntologyError("the extension is empty")
        out = copy.deepcopy(self)
        for kind, target, parse in (("node_types", out.node_types, _node_type), ("edge_types", out.edge_types, _edge_type)):
            for name, spec in (extension.get(kind) or {}).items():
                if name in target:
                    raise OntologyError(f"{kind[:-1].replace('_', ' ')} {name!r} exists")
                target[name] = parse(spec)
        for name, update in (extension.get("node_type_updates") or {}).items():
            if name not in out.node_types:
                raise OntologyError(f"unknown node type {name!r}")
            t = out.node_types[name]
            _add_properties(t["properties"], update.get("add_properties"), name)
            for prop in update.get("relax_properties") or []:
                if prop not in t["properties"]:
                    raise OntologyError(f"unknown property {name}.{prop}")
                t["properties"][prop]["required"] = False
            for sub, spec in (update.get("add_subtypes") or {}).items():
                if sub in t["subtypes"]:
                    raise OntologyError(f"subtype {name}/{sub} exists")
                t["subtypes"][sub] = {"properties": _properties(spec.get("properties"))}
        for name, update in (extension.get("edge_type_updates") or {}).items():
            if name not in out.edge_types:
                raise OntologyError(f"unknown edge type {name!r}")
            e = out.edge_types[name]
            for key, ends in (("add_source_types", "source_types"), ("add_target_types", "target_types")):
                e[ends] += [t for t in update.get(key) or [] if t not in e[ends]]
            _add_properties(e["properties"], update.get("add_properties"), name)
        out.node_types, out.edge_types = dict(sorted(out.node_types.items())), dict(sorted(out.edge_types.items()))
        out.check()
        return out

    # -- comparison ---------------------------------------------------------

    def facts(self) -> list[str]:
        """Sorted statements that the schema makes; constraints member by member, properties as resolved."""
        out = {"version:1"}

        def describe(kind: str, where: str, props: Mapping[str, dict]) -> None:
            for name, p in props.items():
                out.add(f"{kind}:{where}:{name}:{p['value_type']}:{'required' if p['required'] else 'optional'}")
                for c, v in p["constraints"].items():
                    for member in v if isinstance(v, list) else [v]:
                        out.add(f"constraint:{where}:{name}:{c}:{json.dumps(member, sort_keys=True)}")

        for name, t in self.node_types.items():
            out.add(f"type:{name}")
            if t["parent_type"]:
                out.add(f"parent:{name}:{t['parent_type']}")
            describe("prop", name, self.effective_properties(name))
            for sub, s in t["subtypes"].items():
                out.add(f"subtype:{name}:{sub}")
                describe("subprop", f"{name}/{sub}", s["properties"])
        for name, e in self.edge_types.items():
            out.add(f"edge:{name}")
            out |= {f"src:{name}:{t}" for t in e["source_types"]} | {f"tgt:{name}:{t}" for t in e["target_types"]}
            describe("edgeprop", name, e["properties"])
        return sorted(out)

    def facts_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f,) for f in self.facts()], "fact string")

    def compatibility(self, other: Ontology) -> str:
        """identical, superset, subset or divergent, seen from this schema."""
        mine, theirs = set(self.facts()), set(other.facts())
        if mine == theirs:
            return "identical" if self.digest() == other.digest() else "divergent"
        return "superset" if mine > theirs else "subset" if mine < theirs else "divergent"

    # -- validators ---------------------------------------------------------

    def node_error(self, node_type: Column, subtype: Column, properties: Column, need_required: bool | Column = True) -> Column:
        """First violation of an added node, or null."""
        out = F.concat(F.lit("unknown node type: "), F.coalesce(node_type, F.lit("null")))
        for name, t in reversed(self.node_types.items()):
            declared = self.effective_properties(name)
            errors = properties_error(declared, properties, need_required)
            if t["subtypes"]:
                by_sub = errors
                for sub, s in reversed(t["subtypes"].items()):
                    by_sub = F.when(subtype == sub, properties_error(declared | s["properties"], properties, need_required)).otherwise(by_sub)
                errors = F.when(subtype.isNull(), F.lit(f"{name} requires a subtype")).otherwise(by_sub)
            out = F.when(node_type == name, errors).otherwise(out)
        return out

    def edge_error(self, edge_type: Column, source_type: Column, target_type: Column, properties: Column, need_required: bool | Column = True) -> Column:
        """First violation of an added edge whose end types are known, or null."""
        out = F.concat(F.lit("unknown edge type: "), F.coalesce(edge_type, F.lit("null")))
        for name, e in reversed(self.edge_types.items()):
            ends = []
            for side, column, allowed in (("source", source_type, e["source_types"]), ("target", target_type, e["target_types"])):
                family = sorted({t for a in allowed for t in self.family(a)})
                ends.append(F.when(~column.isin(family), F.concat(F.lit(f"{name} does not allow {side} type "), column)))
            out = F.when(edge_type == name, F.coalesce(*ends, properties_error(e["properties"], properties, need_required))).otherwise(out)
        return out

    def update_error(self, node_type: Column, subtype: Column, edge_type: Column, key: Column, value: Column, inherited: bool = True) -> Column:
        """First violation of a single property's update, on a node or (node type null) on an edge."""
        out = F.lit(None).cast("string")
        for name, e in self.edge_types.items():
            out = F.when(node_type.isNull() & (edge_type == name), _update_error(e["properties"], key, value)).otherwise(out)
        for name, t in self.node_types.items():
            declared = self.effective_properties(name) if inherited else t["properties"]
            errors = _update_error(declared, key, value)
            for sub, s in t["subtypes"].items():
                errors = F.when(subtype == sub, _update_error(declared | s["properties"], key, value)).otherwise(errors)
            out = F.when(node_type == name, errors).otherwise(out)
        return out

    # -- the same for one operation on the driver ---------------------------

    def judge_node(self, node_type: str, subtype: str | None, properties: Mapping) -> str | None:
        """As ``node_error``, for one node with encoded properties."""
        t = self.node_types.get(node_type)
        if t is None:
            return f"unknown node type: {node_type}"
        if t["subtypes"] and subtype is None:
            return f"{node_type} requires a subtype"
        extra = t["subtypes"].get(subtype, {"properties": {}})["properties"]
        return judge_properties(self.effective_properties(node_type) | extra, properties)

    def judge_edge(self, edge_type: str, source_type: str, target_type: str, properties: Mapping) -> str | None:
        e = self.edge_types.get(edge_type)
        if e is None:
            return f"unknown edge type: {edge_type}"
        for side, kind, allowed in (("source", source_type, e["source_types"]), ("target", target_type, e["target_types"])):
            if not any(self.is_a(kind, a) for a in allowed):
                return f"{edge_type} does not allow {side} type {kind}"
        return judge_properties(e["properties"], properties)

    def judge_update(self, node_type: str | None, subtype: str | None, edge_type: str | None, key: str, value: Mapping) -> str | None:
        if node_type is not None:
            t = self.node_types.get(node_type, {"subtypes": {}})
            declared = self.effective_properties(node_type) if node_type in self.node_types else {}
            declared = declared | t["subtypes"].get(subtype, {"properties": {}})["properties"]
        else:
            declared = self.edge_types.get(edge_type, {"properties": {}})["properties"]
        return judge_value(key, declared[key], value) if key in declared else None


def _add_properties(props: dict, added: Mapping | None, where: str) -> None:
    for name, spec in (added or {}).items():
        if name in props:
            raise OntologyError(f"property {where}.{name} exists")
        props[name] = _property(spec)


def properties_error(declared: Mapping[str, dict], properties: Column, need_required: bool | Column = True) -> Column:
    """Required properties first, then each declared one in name order."""
    errors = []
    for name, p in sorted(declared.items()):
        if p["required"] and need_required is not False:
            missing = ~F.coalesce(F.map_contains_key(properties, name), F.lit(False))
            errors.append(F.when(missing if need_required is True else missing & need_required, F.lit(f"missing required property {name}")))
    errors += [value_error(name, p, properties[name]) for name, p in sorted(declared.items())]
    return F.coalesce(*errors, F.lit(None).cast("string"))


def _update_error(declared: Mapping[str, dict], key: Column, value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in declared.items():
        out = F.when(key == name, value_error(name, p, value)).otherwise(out)
    return out


def value_error(name: str, p: Mapping, value: Column) -> Column:
    """Kind, then enum, bounds, lengths in bytes and pattern; null passes."""
    import re

    checks = []
    if p["value_type"] != "any":
        checks.append((value["kind"] != p["value_type"], f"{name} is not of type {p['value_type']}"))
    c = p["constraints"]
    text, is_text = value["lit"], value["kind"] == "string"
    number, is_number = value["lit"].try_cast("double"), value["kind"].isin("int", "float")
    if isinstance(c.get("enum"), list):
        checks.append((is_text & ~text.isin([m for m in c["enum"] if isinstance(m, str)]), f"{name} is not one of the allowed values"))
    for key, broken in (("min", lambda b: number < b), ("max", lambda b: number > b), ("min_exclusive", lambda b: number <= b), ("max_exclusive", lambda b: number >= b)):
        if isinstance(c.get(key), int | float) and not isinstance(c.get(key), bool):
            checks.append((is_number & broken(float(c[key])), f"{name} violates {key}"))
    for key, broken in (("min_length", lambda b: F.octet_length(text) < b), ("max_length", lambda b: F.octet_length(text) > b)):
        if isinstance(c.get(key), int) and not isinstance(c.get(key), bool):
            checks.append((is_text & broken(c[key]), f"{name} violates {key}"))
    if isinstance(c.get("pattern"), str):
        try:
            re.compile(c["pattern"])
            broken = is_text & ~text.rlike(c["pattern"])
        except re.error:
            broken = is_text
        checks.append((broken, f"{name} violates pattern"))
    live = value.isNotNull() & (value["kind"] != "null")
    return F.coalesce(*[F.when(live & broken, F.lit(message)) for broken, message in checks], F.lit(None).cast("string"))


def judge_properties(declared: Mapping[str, dict], properties: Mapping) -> str | None:
    """As ``properties_error``, for one operation."""
    for name, p in sorted(declared.items()):
        if p["required"] and name not in properties:
            return f"missing required property {name}"
    return next((e for name, p in sorted(declared.items()) if name in properties and (e := judge_value(name, p, properties[name]))), None)


def judge_value(name: str, p: Mapping, value: Mapping) -> str | None:
    """As ``value_error``, for one encoded value."""
    import re

    kind, text = value["kind"], value["lit"]
    if kind == "null":
        return None
    if p["value_type"] not in ("any", kind):
        return f"{name} is not of type {p['value_type']}"
    c = p["constraints"]
    if kind == "string" and isinstance(c.get("enum"), list) and text not in [m for m in c["enum"] if isinstance(m, str)]:
        return f"{name} is not one of the allowed values"
    if kind in ("int", "float"):
        x = float(text)
        for key, broken in (("min", x.__lt__), ("max", x.__gt__), ("min_exclusive", x.__le__), ("max_exclusive", x.__ge__)):
            if isinstance(c.get(key), int | float) and not isinstance(c.get(key), bool) and broken(float(c[key])):
                return f"{name} violates {key}"
    if kind == "string":
        size = len(text.encode())
        for key, broken in (("min_length", size.__lt__), ("max_length", size.__gt__)):
            if isinstance(c.get(key), int) and not isinstance(c.get(key), bool) and broken(c[key]):
                return f"{name} violates {key}"
        if isinstance(c.get("pattern"), str):
            try:
                fits = re.search(c["pattern"], text) is not None
            except re.error:
                fits = False
            if not fits:
                return f"{name} violates pattern"
    return None
