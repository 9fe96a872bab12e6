"""Deltas and merges between replicas of a log."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import HybridClock, clock
from ..functions.numbering import numbered
from ..functions.schema import ENTRY_NAMES
from ..functions.scratch import written
from . import traverse
from .oplog import OpLog, entry_hash

# Fixed limits of the protocol.
MAX_DRIFT_MS = 1_000_000
MAX_ENTRIES = 100_000
PROTOCOL_VERSION = 3


class BloomFilter:
    """Spark's Bloom filter over strings; merging needs equal sizes."""

    def __init__(self, jvm_filter, count: int = 0):
        self._filter, self.count = jvm_filter, count

    @classmethod
    def empty(cls, spark, expected: int, rate: float = 0.01) -> BloomFilter:
        if expected < 1 or not 0 < rate < 1:
            raise ValueError("expected items and rate must be positive")
        return cls(spark._jvm.org.apache.spark.util.sketch.BloomFilter.create(max(expected, 128), rate))

    @classmethod
    def of(cls, df: DataFrame, column: str, rate: float = 0.01) -> BloomFilter:
        """Built on the executors, merged as a tree."""
        n = df.count()
        return cls(df._jdf.stat().bloomFilter(column, max(n, 128), rate), n)

    def insert(self, item: str) -> None:
        self._filter.putString(item)
        self.count += 1

    def contains(self, item: str) -> bool:
        return self._filter.mightContainString(item)

    def merge(self, other: BloomFilter) -> BloomFilter:
        self._filter.mergeInPlace(other._filter)
        self.count += other.count
        return self

    def n_bits(self) -> int:
        return self._filter.bitSize()


@dataclass
class SyncOffer:
    """What a replica has: its heads and, as a column of hashes, all its entries (exact, so nothing is missed)."""

    heads: DataFrame
    hashes: DataFrame
    clock: HybridClock
    protocol: int = PROTOCOL_VERSION


def offer(log: OpLog, clock: HybridClock) -> SyncOffer:
    return SyncOffer(log.heads(), log.df.select("hash"), clock)


def missing(log: OpLog, remote: SyncOffer) -> DataFrame:
    """The entries that the offering replica lacks, in clock order."""
    if remote.protocol > PROTOCOL_VERSION:
        raise ValueError("unknown protocol version")
    return log.df.join(remote.hashes, "hash", "left_anti").orderBy("physical_ms", "logical", F.desc("clock_id"), "hash")


def needed(log: OpLog, remote: SyncOffer) -> DataFrame:
    """The remote heads that this replica lacks."""
    return remote.heads.join(log.df.select("hash"), "hash", "left_anti")


def filtered_missing(log: OpLog, remote: SyncOffer, node_types: list[str]) -> DataFrame:
    """As ``missing``, for nodes of the given types, with what they build on.

    Wanted are the types' nodes in the whole log, updates and removals of them, edges with a
    wanted end, and schema entries; their ancestors that the remote side lacks come along.
    """
    wanted = log.df.where(F.col("op") == "add_node").where(F.col("node_type").isin(node_types)).select("node_id").distinct()
    lacking = log.df.join(remote.hashes, "hash", "left_anti")

    def of(column: str) -> DataFrame:
        return lacking.join(wanted.withColumnRenamed("node_id", column), column, "left_semi").select("hash")

    schema = lacking.where(F.col("op").isin("define_ontology", "extend_ontology", "checkpoint")).select("hash")
    chosen = schema.unionByName(of("node_id")).unionByName(of("entity_id")).unionByName(of("source_id")).unionByName(of("target_id")).distinct()
    links = lacking.select("hash", F.explode("next").alias("parent"))
    closure = traverse.ancestors(links, chosen)
    return lacking.join(closure, "hash", "left_semi").orderBy("physical_ms", "logical", F.desc("clock_id"), "hash")


def admitted(log: OpLog, incoming: DataFrame, *, instance_id: str | None = None, now_ms: int | None = None, max_entries: int | None = MAX_ENTRIES) -> DataFrame:
    """The incoming entries that are new and pass the gates, as a written table.

    Refused are another replica's checkpoints (unless the log holds no more than its genesis, which they
    can't replace unseen) and entries, schemas apart, dated more than ``MAX_DRIFT_MS`` after ``now_ms``.
    Entries whose hash doesn't fit, parents that neither side has and messages of more than
    ``max_entries`` (None: of any size) are errors.
    """
    if max_entries is not None and incoming.limit(max_entries + 1).count() > max_entries:
        raise ValueError(f"a message has at most {max_entries} entries")
    fresh = incoming.select(*ENTRY_NAMES).dropDuplicates(["hash"]).join(log.df.select("hash"), "hash", "left_anti").select(*ENTRY_NAMES)
    if log.df.limit(2).count() > 1:
        foreign = F.col("op") == "checkpoint"
        fresh = fresh.where(~(foreign if instance_id is None else foreign & (F.col("author") != instance_id)))
    if now_ms is not None:
        fresh = fresh.where((F.col("op") == "define_ontology") | (F.col("physical_ms") <= now_ms + MAX_DRIFT_MS))
    fresh = written(fresh, "admitted")
    if not fresh.where(F.col("hash") != entry_hash()).isEmpty():
        raise ValueError("an entry's hash does not fit its content")
    known = log.df.select(F.col("hash").alias("parent")).unionByName(fresh.select(F.col("hash").alias("parent")))
    orphans = fresh.select("hash", F.explode("next").alias("parent")).join(known, "parent", "left_anti")
    if not orphans.isEmpty():
        raise ValueError("an entry's parent is known to neither side")
    return fresh


def messages(payload: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The payload in clock order, with the number of the message that each entry goes in."""
    rows, _ = numbered(payload.withColumn("_clock", clock()), ["_clock", "hash"], "_n")
    return rows.withColumn("message", F.floor(F.col("_n") / max_entries)).drop("_n", "_clock")


def merge(log: OpLog, incoming: DataFrame, **gates) -> tuple[OpLog, int]:
    """The log with the admitted entries, in whatever order they came, and how many were new."""
    fresh = admitted(log, incoming, **gates)
    return log.merged(fresh), fresh.count()


class PeerRegistry:
    """Peers for fan-out; kept on the driver."""

    def __init__(self, instance_id: str = ""):
        self.instance_id, self._peers = instance_id, {}

    def register(self, peer_id: str, address: str = "") -> None:
        self._peers[peer_id] = {"peer_id": peer_id, "address": address, "last_seen_ms": 0}

    def unregister(self, peer_id: str) -> bool:
        return self._peers.pop(peer_id, None) is not None

    def peers(self) -> list[dict]:
        return [dict(self._peers[k]) for k in sorted(self._peers)]

    def record_sync(self, peer_id: str, at_ms: int) -> None:
        if peer_id not in self._peers:
            raise KeyError(peer_id)
        self._peers[peer_id]["last_seen_ms"] = at_ms

    def select_targets(self, seed: int = 0) -> list[str]:
        """All of up to two peers, else ceil(ln n + 1) of them in an order that the seed and this instance fix."""
        import hashlib

        n = len(self._peers)
        k = n if n <= 2 else min(n, math.ceil(math.log(n) + 1))
        return sorted(self._peers, key=lambda p: hashlib.sha256(f"{seed}:{self.instance_id}:{p}".encode()).digest())[:k]

    def all_synced_since(self, at_ms: int) -> bool:
        return all(p["last_seen_ms"] >= at_ms for p in self._peers.values())
