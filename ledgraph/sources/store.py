"""A store: the log as a Parquet table, with single and bulk writes and the graph on top."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import HybridClock
from ..functions.numbering import numbered
from ..functions.schema import ENTRY_NAMES, layout
from ..functions.scratch import written
from ..functions.values import encode, encode_all
from ..operators import compact as compaction
from ..operators import replay, signing, sync
from ..operators.graph import Graph
from ..operators.ontology import Ontology
from ..operators.oplog import OpLog, hash_of, with_hash
from ..operators.query import Query
from ..operators.replay import Materialized


CODECS = ("none", "snappy", "gzip", "lz4", "zstd")
FLUSH_MODES = ("immediate", "deferred")
FLUSH_AT = 10_000
"""Waiting entries that are flushed even in deferred mode."""
LOOKUPS = 100_000
"""Ids whose state is remembered between writes."""


class ValidationError(ValueError):
    """An operation that the schema or the present graph refuses."""


class GraphStore:
    """Local writes are validated, clocked, hashed and appended; reads are lazy frames over a replay.

    Single writes are judged and hashed on the driver.  They wait in memory until ``flush``, a read or
    ``FLUSH_AT`` entries, and go out as one file; in flush mode ``immediate`` each goes out at once.
    What the present graph says about an id is looked up once and kept up with the writes.
    """

    def __init__(self, spark: SparkSession, instance_id: str, ontology: str | Mapping | Ontology | None = None, path: str | None = None, *, codec: str = "snappy"):
        if codec not in CODECS:
            raise ValueError(f"codec is one of {', '.join(CODECS)}")
        self.codec, self._mode = codec, "deferred"
        self._known: dict[str, dict | None] = {}
        self._waiting: dict[str, list[dict]] = {}
        self._base_graph: Graph | None = None
        self._complete: bool | None = None
        self._schema: Ontology | None = None
        self.spark, self.instance_id, self.path = spark, instance_id, path
        self._pending: list[dict] = []
        self._stored: DataFrame | None = None
        self._callbacks: dict[int, Callable[[dict], None]] = {}
        self._next_callback = 0
        self._cursors: dict[str, list[str]] = {}
        self._key: bytes | None = None
        self._trusted: dict[str, bytes] = {}
        self._strict = False
        self._materialized: Materialized | None = None
        self.peers = sync.PeerRegistry(instance_id)
        self.clock = HybridClock(instance_id)
        self._heads: list[str] | None = []  # None: to be looked up by the next write
        existing = self._existing(path)
        if existing is not None:
            self._stored = existing
            self._heads = None
            last = existing.agg(F.max(F.struct("physical_ms", "logical"))).first()[0]
            if last is not None:
                self.clock = HybridClock(instance_id, last[0], last[1])
            self._base = _ontology(ontology) if ontology is not None else None
        else:
            if ontology is None:
                raise ValueError("a new store needs an ontology")
            self._base = self._schema = _ontology(ontology)
            self._append({"op": "define_ontology", "schema_json": self._base.to_json()})

    @classmethod
    def open(cls, spark: SparkSession, path: str, instance_id: str | None = None, *, codec: str = "snappy") -> GraphStore:
        """The store at a path; rows may be in any order, but no parent may be absent."""
        found = spark.read.schema(layout()).parquet(path)
        first = found.orderBy("physical_ms", "logical", "hash").select("author").first()
        if first is None:
            raise ValueError("the store is empty")
        if not OpLog(found).orphans().isEmpty():
            raise ValueError("an entry's parent is absent")
        return cls(spark, instance_id or first["author"], None, path, codec=codec)

    @classmethod
    def from_snapshot(cls, spark: SparkSession, instance_id: str, snapshot: DataFrame, path: str | None = None) -> GraphStore:
        if snapshot.isEmpty():
            raise ValueError("the snapshot is empty")
        out = cls(spark, instance_id, {}, None)
        out._pending, out._stored, out._base, out.path, out._schema = [], snapshot.select(*ENTRY_NAMES), None, path, None
        if path:
            out._write(out._stored)
        out._settle()
        return out

    def _write(self, rows: DataFrame, mode: str = "append") -> None:
        rows.select(*ENTRY_NAMES).write.mode(mode).option("compression", self.codec).parquet(self.path)
        self._stored = self.spark.read.schema(layout()).parquet(self.path)

    def _settle(self) -> None:
        """Heads and clock from the stored entries; what was derived from others goes."""
        self._known, self._waiting, self._base_graph, self._complete, self._schema, self._materialized = {}, {}, None, None, None, None
        self._heads = None
        last = self._stored.agg(F.max(F.struct("physical_ms", "logical"))).first()[0]
        self.clock = self.clock.merge(HybridClock("", last[0], last[1]))

    def _existing(self, path: str | None) -> DataFrame | None:
        if path is None:
            return None
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        return self.spark.read.schema(layout()).parquet(path)

    # -- writes -------------------------------------------------------------

    def _append(self, fields: Mapping[str, object]) -> str:
        self.clock = self.clock.tick()
        entry = dict.fromkeys(ENTRY_NAMES) | dict(fields)
        entry |= {"author": self.instance_id, "clock_id": self.instance_id, "physical_ms": self.clock.physical_ms, "logical": self.clock.logical, "next": self._parents()}
        entry["hash"] = hash_of(entry)
        if self._key is not None:
            entry["signature"] = signing.sign(self._key, bytes.fromhex(entry["hash"]))
        self._pending.append(entry)
        self._heads = [entry["hash"]]
        self._materialized = None
        if self._mode == "immediate" and self.path or len(self._pending) >= FLUSH_AT:
            self.flush()
        self._notify(entry, True)
        return entry["hash"]

    def _parents(self) -> list[str]:
        """The heads, as an entry names them; all rows of a bulk append are heads until something is built on them."""
        if self._heads is None:
            self._heads = [r["hash"] for r in self.log.heads().collect()]
        return sorted(self._heads)

    def _touch(self, id_: str, change: dict) -> None:
        """Keep what is remembered of an id up with a write."""
        if len(self._known) > 2 * LOOKUPS:
            self._forget()
        if id_ in self._known or self._stored is None or self._complete:
            self._known[id_] = _changed(self._known.get(id_), change)
        else:
            self._waiting.setdefault(id_, []).append(change)

    def _look_up(self, *ids: str) -> list[dict | None]:
        """What lives under each id: a node's type and subtype, or an edge's type; else None.

        The stored entries are asked once for an id, or, if they are few, once for all; waiting ones come on top.
        """
        unknown = [i for i in dict.fromkeys(ids) if i not in self._known]
        if unknown and not self._complete:
            if len(self._known) > LOOKUPS:
                self._forget()
                unknown = list(dict.fromkeys(ids))
            found: dict[str, dict] = {}
            if self._stored is not None:
                if self._base_graph is None:
                    self._base_graph = OpLog(self._visible(self._stored)).graph(self._base)
                g = self._base_graph
                # an entry adds one id at most, so few entries have few ids
                if self._complete is None:
                    self._complete = self._stored.where("op != 'checkpoint'").limit(LOOKUPS // 2 + 1).count() <= LOOKUPS // 2 and self._stored.where("op = 'checkpoint'").isEmpty()
                edges, nodes = (df if self._complete else df.where(F.col(c).isin(unknown)) for df, c in ((g.edges, "edge_id"), (g.nodes, "node_id")))
                for r in edges.select("edge_id", "edge_type", "live").collect():
                    found[r[0]] = r.asDict()
                for r in nodes.select("node_id", "node_type", "subtype", "live").collect():
                    found[r[0]] = r.asDict()
            if self._complete:
                unknown = list(dict.fromkeys([*unknown, *self._waiting, *(i for i in found if i not in self._known)]))
            for i in unknown:
                state = found.get(i)
                for change in self._waiting.pop(i, ()):
                    state = _changed(state, change)
                self._known[i] = state
        return [x if (x := self._known.get(i)) is not None and x["live"] else None for i in ids]

    def _forget(self) -> None:
        """Drop what is remembered of ids; waiting writes are stored first, so that nothing is lost."""
        self.flush()
        self._known, self._waiting, self._base_graph, self._complete = {}, {}, None, None

    def add_node(self, node_id: str, node_type: str, label: str, properties: Mapping | None = None, subtype: str | None = None) -> str:
        props = encode_all(properties)
        self._refuse(self.ontology.judge_node(node_type, subtype, props))
        self._touch(node_id, {"node_type": node_type, "subtype": subtype})
        return self._append({"op": "add_node", "node_id": node_id, "node_type": node_type, "label": label, "subtype": subtype, "properties": props})

    def add_edge(self, edge_id: str, edge_type: str, source_id: str, target_id: str, properties: Mapping | None = None) -> str:
        ends = self._look_up(source_id, target_id)
        for side, id_, end in (("source", source_id, ends[0]), ("target", target_id, ends[1])):
            if end is None or "node_type" not in end:
                raise ValidationError(f"{side} node {id_!r} not found")
        props = encode_all(properties)
        self._refuse(self.ontology.judge_edge(edge_type, ends[0]["node_type"], ends[1]["node_type"], props))
        self._touch(edge_id, {"edge_type": edge_type})
        return self._append({"op": "add_edge", "edge_id": edge_id, "edge_type": edge_type, "source_id": source_id, "target_id": target_id, "properties": props})

    def update_property(self, entity_id: str, key: str, value: object) -> str:
        """Unknown ids are accepted; a known node's or edge's property is checked."""
        e = encode(value)
        found = self._look_up(entity_id)[0]
        if found is not None:
            self._refuse(self.ontology.judge_update(found.get("node_type"), found.get("subtype"), found.get("edge_type"), key, e))
        return self._append({"op": "update_property", "entity_id": entity_id, "key": key, "value": e})

    def remove_node(self, node_id: str) -> str:
        self._touch(node_id, {"gone": "node_type"})
        return self._append({"op": "remove_node", "node_id": node_id})

    def remove_edge(self, edge_id: str) -> str:
        self._touch(edge_id, {"gone": "edge_type"})
        return self._append({"op": "remove_edge", "edge_id": edge_id})

    def extend_ontology(self, extension: str | Mapping) -> str:
        text = extension if isinstance(extension, str) else json.dumps(extension, sort_keys=True)
        more = self.ontology.extended(text)
        out = self._append({"op": "extend_ontology", "schema_json": text})
        self._forget()
        self._schema = more
        return out

    def apply_raw(self, row: Mapping) -> str:
        fields = {k: v for k, v in row.items() if k != "op"}
        return getattr(self, row["op"])(**fields)

    @staticmethod
    def _refuse(problem: str | None) -> None:
        if problem:
            raise ValidationError(problem)

    def append_ops(self, operations: DataFrame) -> int:
        """Bulk append: rows of operands get consecutive clocks under one parent set, in their given (or id) order.

        They are sorted and numbered over the cluster: each task counts its range, and only the counts meet.
        """
        self.clock = self.clock.tick()
        self.flush()
        order = [c for c in ("seq", "node_id", "edge_id", "entity_id", "key") if c in operations.columns]
        rows, n = numbered(operations, order, "_n")
        if not n:
            return 0
        rows = rows.withColumn("logical", (F.col("_n") + self.clock.logical + 1).cast("int")).drop("seq", "_n")
        rows = rows.withColumn("physical_ms", F.lit(self.clock.physical_ms)).withColumn("author", F.lit(self.instance_id)).withColumn("clock_id", F.lit(self.instance_id)).withColumn("next", F.array(*(F.lit(h) for h in self._parents())))
        entries = with_hash(rows)
        if self.path:
            self._write(entries)
        else:
            entries = written(entries, "entries")
            self._stored = entries if self._stored is None else self._stored.unionByName(entries)
        self.clock = HybridClock(self.instance_id, self.clock.physical_ms, self.clock.logical + n + 1)
        self._known, self._base_graph, self._complete, self._materialized = {}, None, None, None
        self._heads = None
        return n

    # -- durability ---------------------------------------------------------

    def set_flush_mode(self, mode: str) -> None:
        """``immediate``: each write is stored at once; ``deferred``: writes wait for a flush.  Stores without a path keep all in memory."""
        if mode not in FLUSH_MODES:
            raise ValueError(f"flush mode is one of {', '.join(FLUSH_MODES)}")
        self._mode = mode
        if mode == "immediate":
            self.flush()

    def pending_flush_count(self) -> int:
        return len(self._pending)

    def flush(self) -> int:
        """One append for all waiting entries."""
        n = len(self._pending)
        if n:
            rows = self.spark.createDataFrame([tuple(e[c] for c in layout().names) for e in self._pending], layout())
            if self.path:
                self._write(rows.coalesce(1))
            else:
                self._stored = rows if self._stored is None else self._stored.unionByName(rows)
            self._pending, self._waiting, self._base_graph = [], {}, None
        return n

    def reclaim_disk(self) -> int:
        """Rewrite the stored entries in as few files as their size asks for; the bytes saved."""
        if not self.path:
            return 0
        self.flush()
        before = self._bytes()
        self._write(written(self._stored.repartitionByRange("physical_ms", "logical", "hash"), "compact"), "overwrite")
        return max(0, before - self._bytes())

    def _bytes(self) -> int:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()

    # -- reads --------------------------------------------------------------

    @property
    def log(self) -> OpLog:
        self.flush()
        return OpLog(self._visible(self._stored))

    def _visible(self, df: DataFrame) -> DataFrame:
        return signing.accepted(df, self._trusted, self._strict) if self._trusted or self._strict else df

    def materialize(self) -> Materialized:
        if self._materialized is None:
            self._materialized = self.log.materialize(self._base)
        return self._materialized

    @property
    def ontology(self) -> Ontology:
        if self._schema is None:
            self._schema = self.materialize().ontology
        return self._schema

    def ontology_json(self) -> str:
        return self.ontology.to_json()

    def node_type_names(self) -> list[str]:
        return list(self.ontology.node_types)

    def edge_type_names(self) -> list[str]:
        return list(self.ontology.edge_types)

    def clock_time(self) -> tuple[int, int]:
        return self.clock.as_tuple()

    def __len__(self) -> int:
        return (0 if self._stored is None else self._visible(self._stored).count()) + len(self._pending)

    def get(self, hash_: str) -> dict | None:
        """One entry by its hash; what is no hash is an error."""
        row = self.log.get(hash_).first()
        return None if row is None else row.asDict(recursive=True)

    def memory_usage(self) -> int:
        return self.log.memory_usage()

    def verify_integrity(self) -> bool:
        return self.log.verify_integrity()

    def graph(self) -> Graph:
        m = self.materialize()
        return Graph(m.nodes, m.edges, m.ontology, instance_id=self.instance_id)

    def query(self, engine=None) -> Query:
        return Query(self.graph(), engine)

    def as_of(self, physical_ms: int, logical: int = 0) -> Graph:
        return self.log.snapshot_at(physical_ms, logical)

    def get_quarantined(self) -> DataFrame:
        return self.materialize().quarantine.orderBy("hash")

    def revalidate(self) -> int:
        """How many entries that the first schema keeps in quarantine the present one frees."""
        m = self.materialize()
        base = self._base or replay.fold_schema(self.log.df.where("op in ('define_ontology', 'checkpoint')"))[0]
        before = replay.materialize(self.log.df.where("op != 'extend_ontology'"), base).quarantine.select("hash").distinct()
        return before.join(m.quarantine.select("hash"), "hash", "left_anti").count()

    def snapshot(self) -> DataFrame:
        return self.log.df

    # -- replication --------------------------------------------------------

    def generate_sync_offer(self) -> sync.SyncOffer:
        return sync.offer(self.log, self.clock)

    def receive_sync_offer(self, offer: sync.SyncOffer) -> DataFrame:
        return sync.missing(self.log, offer)

    def receive_filtered_sync_offer(self, offer: sync.SyncOffer, node_types: list[str]) -> DataFrame:
        return sync.filtered_missing(self.log, offer, node_types)

    def merge_sync_payload(self, entries: DataFrame) -> int:
        """Take in the entries that pass the gates and the signature rules; how many were new."""
        fresh = sync.admitted(self.log, self._visible(entries), instance_id=self.instance_id, now_ms=self.clock.physical_ms)
        n = fresh.count()
        if n:
            if self.path:
                self._write(fresh)
            else:
                self._stored = self._stored.unionByName(fresh)
            self._settle()
            if self._callbacks:
                for row in fresh.orderBy("physical_ms", "logical", "hash").toLocalIterator():
                    self._notify(row.asDict(recursive=True), False)
        return n

    # -- subscriptions ------------------------------------------------------

    def subscribe(self, callback: Callable[[dict], None]) -> int:
        self._next_callback += 1
        self._callbacks[self._next_callback] = callback
        return self._next_callback

    def unsubscribe(self, id_: int) -> bool:
        return self._callbacks.pop(id_, None) is not None

    def _notify(self, entry: dict, local: bool) -> None:
        event = {k: v for k, v in entry.items() if v is not None and k not in ("next", "signature")} | {"local": local}
        for callback in list(self._callbacks.values()):
            try:
                callback(event)
            except Exception:  # noqa: BLE001, S110  a listener's failure is not the writer's
                pass

    def register_subscriber_cursor(self, name: str, cursor: list[str]) -> None:
        self._cursors[name] = list(cursor)

    def unregister_subscriber_cursor(self, name: str) -> bool:
        return self._cursors.pop(name, None) is not None

    # -- compaction ---------------------------------------------------------

    def verify_compaction_safe(self) -> tuple[bool, list[str]]:
        # one more than the longest cursor tells that a cursor lacks some
        most = max((len(set(c)) for c in self._cursors.values()), default=0) + 1
        heads = {r["hash"] for r in self.log.heads().limit(most).collect()} if self._cursors else set()
        reasons = [f"subscriber {name} is behind" for name, cursor in self._cursors.items() if set(cursor) != heads]
        if not self.peers.all_synced_since(self.clock.physical_ms):
            reasons.append("a peer has not synced the latest entry")
        return not reasons, reasons

    def compact(self, safe: bool = True, reclaim_disk: bool = False) -> str:
        if safe:
            ok, reasons = self.verify_compaction_safe()
            if not ok:
                raise RuntimeError("; ".join(reasons))
        self.clock = self.clock.tick()
        small = written(compaction.compact(self.log, self.materialize(), self.instance_id, self.clock.physical_ms).df, "compacted")
        if self.path:
            self._write(small, "overwrite")
        else:
            self._stored = small
        self._base = None
        self._settle()
        if reclaim_disk:
            self.reclaim_disk()
        return self._stored.where("op = 'checkpoint'").first()["hash"]

    # -- signatures ---------------------------------------------------------

    def generate_signing_key(self) -> str:
        import os

        self._key = os.urandom(32)
        return self.get_public_key()

    def set_signing_key(self, hex_key: str) -> None:
        key = bytes.fromhex(hex_key)
        if len(key) != 32:
            raise ValueError("a key has 32 bytes")
        self._key = key

    def get_public_key(self) -> str | None:
        return None if self._key is None else signing.public_key(self._key).hex()

    def register_trusted_author(self, author: str, hex_key: str) -> None:
        self._trusted[author] = bytes.fromhex(hex_key)

    def set_require_signatures(self, strict: bool) -> None:
        self._strict = strict


def _changed(state: dict | None, change: dict) -> dict | None:
    """An id's state after a write; the type is that of the first addition."""
    if "gone" in change:
        return {**state, "live": False} if state is not None and change["gone"] in state else state
    kind = "node_type" if "node_type" in change else "edge_type"
    if state is None or kind not in state:
        return {**change, "live": True} if state is None or kind == "node_type" else state
    return {**state, **change, kind: state[kind], "live": True}


def _ontology(spec: str | Mapping | Ontology) -> Ontology:
    return spec if isinstance(spec, Ontology) else Ontology(spec)
