"""Compaction: the live graph as one checkpoint entry, and policies for when."""

from __future__ import annotations

import time
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import CHECKPOINT, ENTRY_NAMES, OPERAND_NAMES
from ..functions.scratch import written
from .oplog import OpLog, with_hash
from .replay import Materialized

INNER = CHECKPOINT.removeprefix("array<").removesuffix(">")


def _op(op: str, **values: Column) -> Column:
    """A checkpoint operation; operands that are not given are null."""
    kinds = dict(_fields())
    named = {"op": F.lit(op), **values}
    return F.struct(*(named[name].cast(kinds[name]).alias(name) if name in named else F.lit(None).cast(kinds[name]).alias(name) for name in [*OPERAND_NAMES, "physical_ms", "logical", "clock_id"]))


def _fields() -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(f"x {INNER}")["x"].dataType]


def checkpoint_operations(m: Materialized) -> DataFrame:
    """(step, id, name, x): for each live entity its addition, then one update for each property, with their own clocks."""
    # the write order inverts the clock id, so the adding clock is looked up again
    adds = m.operations.where(F.col("op").isin("add_node", "add_edge")).groupBy(F.coalesce("node_id", "edge_id").alias("id"), "op").agg(
        F.max_by(F.struct("physical_ms", "logical", "clock_id"), "clock").alias("at")
    )

    def part(entities: DataFrame, kind: str, step: int, values: dict[str, Column]) -> DataFrame:
        id_ = f"{kind}_id"
        # a property keeps its clock, an addition gets that of the last one
        rows = entities.where("live").join(adds.where(F.col("op") == f"add_{kind}").select(F.col("id").alias(id_), "at"), id_)
        added = rows.select(
            F.lit(step).alias("step"), F.col(id_).alias("id"), F.lit("").alias("name"),
            _op(f"add_{kind}", properties=_empty(), physical_ms=F.col("at.physical_ms"), logical=F.col("at.logical"), clock_id=F.col("at.clock_id"), **values).alias("x"),
        )
        each = rows.select(F.col(id_).alias("id"), F.explode(F.map_entries("properties")).alias("p"), "property_clocks").withColumn("c", F.col("property_clocks")[F.col("p.key")])
        updates = each.select(
            F.lit(step + 1).alias("step"), "id", F.col("p.key").alias("name"),
            _op("update_property", entity_id=F.col("id"), key=F.col("p.key"), value=F.col("p.value"), physical_ms=F.col("c.physical_ms"), logical=F.col("c.logical"), clock_id=F.col("c.clock_id")).alias("x"),
        )
        return added.unionByName(updates)

    node = {c: F.col(c) for c in ("node_id", "node_type", "subtype", "label")}
    edge = {c: F.col(c) for c in ("edge_id", "edge_type", "source_id", "target_id")}
    return part(m.nodes, "node", 1, node).unionByName(part(m.edges, "edge", 3, edge))


def checkpoint(log: OpLog, m: Materialized, author: str, physical_ms: int, logical: int = 0) -> DataFrame:
    """The checkpoint entry as a one-row frame in the log's layout.

    An entry is one row by definition of the format, so the live graph meets in one row here:
    for graphs beyond a row, keep ``checkpoint_operations`` as a table instead.
    """
    schema = log.df.sparkSession.range(1).select(F.lit(0).alias("step"), F.lit("").alias("id"), F.lit("").alias("name"), _op("define_ontology", schema_json=F.lit(m.ontology.to_json()), physical_ms=F.lit(0), logical=F.lit(0), clock_id=F.lit(author)).alias("x"))
    # maps have no order, and those of additions are empty: without them rows are sorted natively, not by a comparing expression
    rows = schema.unionByName(checkpoint_operations(m)).select(F.struct("step", "id", "name", F.col("x").dropFields("properties").alias("y")).alias("s"))
    properties = lambda y: F.when(y["op"].isin("add_node", "add_edge"), _empty())
    whole = lambda y: F.struct(*((properties(y) if n == "properties" else y[n]).cast(kind).alias(n) for n, kind in _fields()))
    boxed = rows.agg(F.sort_array(F.collect_list("s")).alias("s")).select(F.transform("s", lambda s: whole(s["y"])).alias("ckpt_ops"))
    return with_hash(boxed.select(F.lit("checkpoint").alias("op"), F.lit(author).alias("author"), F.lit(author).alias("clock_id"), F.lit(physical_ms).alias("physical_ms"), F.lit(logical).alias("logical"), "ckpt_ops"))


def _empty() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<kind:string,lit:string>>"))


def compact(log: OpLog, m: Materialized, author: str, physical_ms: int) -> OpLog:
    """A log of the checkpoint and the quarantined entries, re-rooted at it."""
    root = written(checkpoint(log, m, author, physical_ms), "checkpoint")
    hash_ = root.first()["hash"]
    kept = log.df.join(m.quarantine.select("hash").distinct(), "hash", "left_semi").drop("hash").withColumn("next", F.array(F.lit(hash_)))
    return OpLog(root.select(*ENTRY_NAMES).unionByName(written(with_hash(kept), "carried")))


class CompactionPolicy(Protocol):
    def should_compact(self, store) -> bool: ...

    def check(self, store) -> str | None: ...


class _Policy:
    reclaim_disk = False

    def should_compact(self, store) -> bool:
        raise NotImplementedError

    def check(self, store) -> str | None:
        """Compact the store if it is time; the checkpoint's hash, or None.  Peers are the caller's matter."""
        return store.compact(safe=False, reclaim_disk=self.reclaim_disk) if self.should_compact(store) else None


class IntervalPolicy(_Policy):
    """The first check compacts, later ones after so many seconds."""

    def __init__(self, seconds: float, reclaim_disk: bool = False):
        self.seconds, self.reclaim_disk, self._last = seconds, reclaim_disk, None

    def should_compact(self, store=None) -> bool:
        now = time.monotonic()
        if self._last is not None and now - self._last < self.seconds:
            return False
        self._last = now
        return True


class ThresholdPolicy(_Policy):
    """More than so many entries; takes a store or a number of entries."""

    def __init__(self, max_entries: int = 1000, reclaim_disk: bool = False):
        self.max_entries, self.reclaim_disk = max_entries, reclaim_disk

    def should_compact(self, store) -> bool:
        return (store if isinstance(store, int) else len(store)) > self.max_entries
