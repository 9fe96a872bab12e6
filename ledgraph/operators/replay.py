"""Replay of the log to nodes, edges and quarantine.

Everything is a set-based aggregate per entity, so that partial results combine
before the shuffle and a very hot entity is no single task's burden:

* ``pos`` orders operations: (checkpoint rows first, clock, hash, place inside a
  checkpoint).  In ``hlc`` order the clock decides; in ``causal`` order a
  position computed from the log's DAG does.
* Type and ends come from the first valid add (``min_by``), label and subtype
  from the last (``max_by``), each property from the greatest clock.
* An entity lives unless a remove stands after its last add.
* Additions and updates are judged by the final schema, compiled to Columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import clock, descending
from ..functions.schema import OPERAND_NAMES
from ..functions.scratch import written
from .ontology import Ontology, OntologyError


@dataclass
class Materialized:
    nodes: DataFrame
    edges: DataFrame
    quarantine: DataFrame
    ontology: Ontology
    operations: DataFrame


def fold_schema(oplog: DataFrame, base: Ontology | None = None) -> tuple[Ontology, dict[str, str]]:
    """The final schema, and the hashes of extensions that it refused with reasons.  Schema rows are few."""
    return _folded(_schema_rows(oplog), base)


def _schema_rows(oplog: DataFrame) -> list[Row]:
    return oplog.where(F.col("op").isin("define_ontology", "extend_ontology", "checkpoint")).select(
        "hash", "op", "schema_json", "physical_ms", "logical", "clock_id", F.expr("filter(ckpt_ops, x -> x.op in ('define_ontology', 'extend_ontology'))").alias("inner")
    ).collect()


def _folded(rows: list[Row], base: Ontology | None) -> tuple[Ontology, dict[str, str]]:
    steps = []
    for r in rows:
        if r["op"] == "checkpoint":
            steps += [((0, r["physical_ms"], r["logical"], f"{i:09d}"), r["hash"], x["op"], x["schema_json"]) for i, x in enumerate(r["inner"] or [])]
        else:
            steps.append(((1, r["physical_ms"], r["logical"], r["hash"]), r["hash"], r["op"], r["schema_json"]))
    schema, refused = base, {}
    for _, hash_, op, text in sorted(steps, key=lambda s: s[0]):
        if op == "define_ontology":
            schema = schema or Ontology(text)  # the first one counts
            continue
        try:
            schema = (schema or Ontology({})).extended(text)
        except OntologyError as e:
            refused[hash_] = str(e)
    return schema or Ontology({}), refused


def operations(oplog: DataFrame, positions: DataFrame | None = None, checkpoints: bool = False) -> DataFrame:
    """One row per operation, checkpoints taken apart, with pos, the clock and the rank among property writes.

    ``checkpoints``: there are some, and they are taken apart once, into a table, not by a single task for each use.
    """
    plain = oplog.where("op != 'checkpoint'").select("hash", "physical_ms", "logical", "clock_id", *OPERAND_NAMES, F.lit(1).alias("rank"), F.lit(0).alias("inner"), clock().alias("placed"))
    boxed = (
        oplog.where("op = 'checkpoint'")
        .select("hash", "clock_id", clock().alias("placed"), F.posexplode("ckpt_ops").alias("inner", "x"))
        .select("hash", F.col("x.physical_ms").alias("physical_ms"), F.col("x.logical").alias("logical"), F.coalesce("x.clock_id", "clock_id").alias("clock_id"), *(F.col(f"x.{c}").alias(c) for c in OPERAND_NAMES), F.lit(0).alias("rank"), "inner", "placed")
    )
    out = plain.unionByName(written(boxed, "boxed") if checkpoints else boxed)
    if positions is None:
        pos = F.struct("rank", "placed", "hash", "inner")
    else:
        out = out.join(positions.select("hash", F.col("pos").alias("place")), "hash")
        pos = F.struct("rank", "place", "hash", "inner")
    # of equal clocks the earliest write counts
    write = F.struct(clock().alias("clock"), descending(F.col("hash")).alias("h"), (-F.col("inner")).alias("i"))
    # what a checkpoint holds stands where the checkpoint does, in its order; writes keep their own clocks
    return out.withColumn("pos", pos).withColumn("clock", clock()).withColumn("write", write)


def _entity(ops: DataFrame, key: str, add: str, remove: str, firsts: list[str], lasts: list[str], at: str = "pos") -> DataFrame:
    """Identity, first and last add, and liveness of each entity."""
    is_add, is_remove = F.col("op") == add, F.col("op") == remove
    added = F.when(is_add, F.col(at))
    out = ops.groupBy(key).agg(
        F.min(added).alias("first_pos"),
        F.max(added).alias("last_pos"),
        F.max(F.when(is_add, F.col("clock"))).alias("add_clock"),
        F.max(F.when(is_remove, F.struct(F.col("pos"), F.col("clock")))).alias("removed"),
        *(F.min_by(c, added).alias(c) for c in firsts),
        *(F.max_by(c, added).alias(c) for c in lasts),
    )
    dead = (F.col("removed.pos") > F.col("last_pos")) & (F.col("removed.clock") > F.col("add_clock"))
    return out.where(F.col("first_pos").isNotNull()).withColumn("live", ~F.coalesce(dead, F.lit(False))).drop("removed")


def _properties(adds: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """(key, properties, property_clocks): the write with the greatest clock for each property."""
    first = adds.select(key, F.explode("properties").alias("name", "value"), "write", "physical_ms", "logical", "clock_id")
    later = updates.select(F.col("entity_id").alias(key), F.col("key").alias("name"), "value", "write", "physical_ms", "logical", "clock_id")
    each = first.unionByName(later).groupBy(key, "name").agg(F.max_by(F.struct("value", F.struct("physical_ms", "logical", "clock_id").alias("at")), "write").alias("best"))
    return each.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("best.value").alias("value"))), _by_name)).alias("properties"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("best.at").alias("at"))), _by_name)).alias("property_clocks"),
    )


def _by_name(a: Column, b: Column) -> Column:
    return F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)


def materialize(oplog: DataFrame, ontology: Ontology | None = None, *, order: str = "hlc", positions: DataFrame | None = None, inherited_updates: bool = True) -> Materialized:
    """Nodes, edges and quarantine of the log.  ``order="causal"`` needs the positions of ``oplog.causal_positions``."""
    if order not in ("hlc", "causal") or (order == "causal") != (positions is not None):
        raise ValueError("order is hlc, or causal with positions")
    rows = _schema_rows(oplog)
    schema, refused = _folded(rows, ontology)
    digest = schema.digest()
    ops = operations(oplog, positions, any(r["op"] == "checkpoint" for r in rows))
    boxed = F.col("rank") == 0
    node_adds = ops.where("op = 'add_node'").withColumn("error", schema.node_error(F.col("node_type"), F.col("subtype"), F.col("properties"), ~boxed))
    good_adds = node_adds.where("error is null").drop("error")
    removes = ops.where("op = 'remove_node'")
    identity = _entity(good_adds.unionByName(removes), "node_id", "add_node", "remove_node", ["node_type"], ["label", "subtype"])
    # edges wait for both ends
    ends = identity.select("node_id", "node_type", "first_pos")
    src = ends.select(F.col("node_id").alias("source_id"), F.col("node_type").alias("source_type"), F.col("first_pos").alias("source_pos"))
    dst = ends.select(F.col("node_id").alias("target_id"), F.col("node_type").alias("target_type"), F.col("first_pos").alias("target_pos"))
    edge_adds = ops.where("op = 'add_edge'").join(src, "source_id", "left").join(dst, "target_id", "left")
    known = F.array([F.lit(t) for t in schema.edge_types]) if schema.edge_types else F.array().cast("array<string>")
    waiting = F.col("source_pos").isNull() | F.col("target_pos").isNull()
    edge_error = (
        F.when(F.coalesce(~F.array_contains(known, F.col("edge_type")), F.lit(True)), F.concat(F.lit("unknown edge type: "), F.coalesce("edge_type", F.lit("null"))))
        .when(waiting, F.when(F.col("source_pos").isNull(), F.lit("source node not found")).otherwise("target node not found"))
        .otherwise(schema.edge_error(F.col("edge_type"), F.col("source_type"), F.col("target_type"), F.col("properties"), ~boxed))
    )
    edge_adds = edge_adds.withColumn("error", edge_error).withColumn("ready", F.greatest("pos", "source_pos", "target_pos"))
    good_edges = edge_adds.where("error is null").drop("error", "source_type", "target_type", "source_pos", "target_pos")
    edge_removes = ops.where("op = 'remove_edge'").withColumn("ready", F.col("pos"))
    edge_identity = _entity(good_edges.unionByName(edge_removes), "edge_id", "add_edge", "remove_edge", ["edge_type", "source_id", "target_id"], [], "ready")
    # updates go to a node of that id, else to an edge, and only after it exists; nodes don't wait for edges
    none = F.lit(None).cast("string")
    updates = ops.where("op = 'update_property'").drop("node_type", "edge_type")
    of_node = identity.select(F.col("node_id").alias("entity_id"), F.col("node_type").alias("t"), F.col("first_pos").alias("since"))
    of_edge = edge_identity.select(F.col("edge_id").alias("entity_id"), F.col("edge_type").alias("t"), F.col("first_pos").alias("since"))
    node_updates = updates.join(of_node, "entity_id").where("since < pos")
    if any(t["subtypes"] for t in schema.node_types.values()):
        node_updates = _with_subtype(node_updates.drop("subtype"), good_adds, schema)
    edge_updates = updates.join(of_node.select("entity_id"), "entity_id", "left_anti").join(of_edge, "entity_id").where("since < pos")
    node_updates = node_updates.withColumn("error", schema.update_error(F.col("t"), F.col("subtype"), none, F.col("key"), F.col("value"), inherited_updates))
    edge_updates = edge_updates.withColumn("error", schema.update_error(none, none, F.col("t"), F.col("key"), F.col("value"), inherited_updates))
    nodes = _finish(identity, _properties(good_adds, node_updates.where("error is null"), "node_id"), "node_id").select("node_id", "node_type", "subtype", "label", "properties", "property_clocks", "add_clock", "live")
    edges = _finish(edge_identity, _properties(good_edges, edge_updates.where("error is null"), "edge_id"), "edge_id").select("edge_id", "edge_type", "source_id", "target_id", "properties", "property_clocks", "add_clock", "live")
    bad = [df.where("error is not null").select("hash", "op", F.col("error").alias("reason")) for df in (node_adds, edge_adds, node_updates, edge_updates)]
    quarantine = reduce(DataFrame.unionByName, bad)
    if refused:
        quarantine = quarantine.unionByName(oplog.sparkSession.createDataFrame([(h, "extend_ontology", r) for h, r in refused.items()], "hash string, op string, reason string"))
    quarantine = quarantine.withColumn("ontology_hash", F.lit(digest))
    return Materialized(nodes, edges, quarantine, schema, ops)


def _finish(identity: DataFrame, props: DataFrame, key: str) -> DataFrame:
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<kind:string,lit:string>>"))
    return identity.join(props, key, "left").withColumn("properties", F.coalesce("properties", empty))


def _with_subtype(updates: DataFrame, adds: DataFrame, schema: Ontology) -> DataFrame:
    """The subtype that an entity has when the update comes: that of its last add before; only types with subtypes need it."""
    typed = [t for t, spec in schema.node_types.items() if spec["subtypes"]]
    needs = F.col("t").isin(typed)
    plain = updates.where(~F.coalesce(needs, F.lit(False))).withColumn("subtype", F.lit(None).cast("string"))
    some = updates.where(needs)
    marks = adds.where(F.col("node_type").isin(typed)).select(F.col("node_id").alias("entity_id"), "pos", F.struct("subtype").alias("s"))
    names = some.columns
    both = some.withColumn("s", F.lit(None).cast("struct<subtype:string>")).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy("entity_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    filled = both.withColumn("subtype", F.last("s", True).over(w)["subtype"]).where("op is not null")
    return plain.unionByName(filled.select(*names, "subtype"))
