"""The operation log: an append-only, content-addressed DAG of entries as a DataFrame."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.schema import ENTRY_NAMES, OPERAND_NAMES, layout
from ..functions.scratch import written
from . import replay, traverse
from .graph import Graph
from .ontology import Ontology

_CONTROL = re.compile(r"\\\\|\\u00[0-9a-f]{2}")


def entry_hash() -> Column:
    """Digest of payload, parents, clock and author; properties in the order of their names."""
    operands = [F.map_from_entries(F.array_sort(F.map_entries("properties"))).alias(c) if c == "properties" else F.col(c) for c in OPERAND_NAMES]
    return F.sha2(F.to_json(F.struct(*operands, "ckpt_ops", F.array_sort("next").alias("next"), "physical_ms", "logical", "clock_id", "author")), 256)


def hash_of(entry: Mapping) -> str:
    """The same digest of one entry (not a checkpoint) without Spark, for single writes."""
    row: dict[str, object] = {c: entry.get(c) for c in OPERAND_NAMES}
    if row["properties"] is not None:
        row["properties"] = {k: {"kind": v["kind"], "lit": v["lit"]} for k, v in sorted(row["properties"].items())}
    row |= {"next": sorted(entry["next"]), **{c: entry[c] for c in ("physical_ms", "logical", "clock_id", "author")}}
    text = json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(_CONTROL.sub(lambda m: m[0][:2] + m[0][2:].upper(), text).encode()).hexdigest()


def _in_order() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function that goes to workers by value, which need not have this package."""

    def order(pairs: pd.DataFrame) -> pd.DataFrame:
        """(id, place) in the order in which entries are freed; ids follow the order of ties, a pair without a parent tells an id."""
        ids, parents = pairs["id"].to_numpy(), pairs["parent_id"].to_numpy()
        n = int(ids.max()) + 1 if len(ids) else 0
        known = parents >= 0
        ids, parents = ids[known], parents[known]
        open_ = np.bincount(ids, minlength=n)
        by = np.lexsort((ids, parents))
        children, starts = ids[by], np.searchsorted(parents[by], np.arange(n + 1))
        out = np.empty(n, "int64")
        roots = np.flatnonzero(open_ == 0)
        out[: len(roots)], end, at = roots, len(roots), 0
        while at < end:
            h = out[at]
            at += 1
            for c in children[starts[h] : starts[h + 1]]:
                open_[c] -= 1
                if open_[c] == 0:
                    out[end] = c
                    end += 1
        return pd.DataFrame({"id": out[:end], "place": np.arange(end)})

    return order


class OpLog:
    def __init__(self, df: DataFrame):
        self.df = df.select(*ENTRY_NAMES)

    @cached_property
    def links(self) -> DataFrame:
        """(hash, parent)."""
        return self.df.select("hash", F.explode("next").alias("parent"))

    # -- lookups ------------------------------------------------------------

    def get(self, hash_: str) -> DataFrame:
        if len(hash_) != 64 or set(hash_) - set("0123456789abcdef"):
            raise ValueError("not a hash")
        return self.df.where(F.col("hash") == hash_)

    def count(self) -> int:
        return self.df.count()

    def heads(self) -> DataFrame:
        """Entries that no entry names as a parent."""
        return self.df.select("hash").join(self.links.select(F.col("parent").alias("hash")), "hash", "left_anti")

    def heads_known(self, cursor: list[str] | DataFrame) -> bool:
        if isinstance(cursor, DataFrame):
            return cursor.join(self.df.select("hash"), "hash", "left_anti").isEmpty()
        wanted = set(cursor)
        return self.df.where(F.col("hash").isin(list(wanted))).select("hash").distinct().count() == len(wanted)

    def entries_since(self, cursor: list[str] | str | DataFrame | None = None) -> DataFrame:
        """Entries that are no ancestors of the cursor (hashes, or a frame of them), in clock order; unknown hashes are an error."""
        if not isinstance(cursor, DataFrame):
            cursor = [cursor] if isinstance(cursor, str) else list(cursor or [])
        out = self.df
        if isinstance(cursor, DataFrame) or cursor:
            if not self.heads_known(cursor):
                raise ValueError("unknown hash in cursor")
            heads = cursor if isinstance(cursor, DataFrame) else self.df.sparkSession.createDataFrame([(h,) for h in cursor], "hash string")
            out = out.join(traverse.ancestors(self.links, heads), "hash", "left_anti")
        return out.orderBy("physical_ms", "logical", F.desc("clock_id"), "hash")

    def entries_affecting(self, entity: str) -> DataFrame:
        named = ("node_id", "edge_id", "source_id", "target_id", "entity_id")
        here = F.coalesce(*(F.when(F.col(c) == entity, True) for c in named), F.lit(False))
        inside = F.exists("ckpt_ops", lambda x: F.coalesce(*(F.when(x[c] == entity, True) for c in named), F.lit(False)))
        return self.df.where(here | F.coalesce(inside, F.lit(False))).orderBy("physical_ms", "logical", F.desc("clock_id"), "hash")

    def memory_usage(self) -> int:
        """Estimated bytes of the entries as JSON."""
        return self.df.select(F.sum(F.octet_length(F.to_json(F.struct(*[c for c in ENTRY_NAMES if c != "signature"]))))).first()[0] or 0

    # -- integrity ----------------------------------------------------------

    def violations(self) -> DataFrame:
        """(hash, problem): wrong hashes, absent parents, repeated hashes."""
        wrong = self.df.where(entry_hash() != F.col("hash")).select("hash", F.lit("hash does not fit the content").alias("problem"))
        known = self.df.select(F.col("hash").alias("parent"))
        orphan = self.links.join(known, "parent", "left_anti").select("hash", F.lit("parent is absent").alias("problem"))
        twice = self.df.groupBy("hash").count().where("count > 1").select("hash", F.lit("hash is repeated").alias("problem"))
        return wrong.unionByName(orphan).unionByName(twice).distinct()

    def verify_integrity(self) -> bool:
        return self.violations().isEmpty()

    def orphans(self) -> DataFrame:
        """(hash, parent) of parents that the log lacks; repeated parents are told once."""
        parents = self.links.select("parent").distinct().join(self.df.select(F.col("hash").alias("parent")), "parent", "left_anti")
        return self.links.join(parents, "parent", "left_semi").select("hash", "parent")

    # -- order --------------------------------------------------------------

    def causal_positions(self) -> DataFrame:
        """(hash, pos): first-in-first-out topological order, ties by (physical, logical, hash).

        An entry is freed by the last of its parents, so the order is that of (place of the last parent, clock,
        hash): sorted and numbered over the cluster once the places of entries that others build on are known.
        Among these alone the order is sequential by nature (a single writer's log is one chain); it is computed in
        one group over pairs of numbers.  The default ``hlc`` order needs none of this.
        """
        key = ["physical_ms", "logical", "hash"]
        rows = written(self.df.select("next", *key).dropDuplicates(["hash"]), "narrow")
        links = rows.select("hash", F.explode("next").alias("parent")).distinct()
        links = written(links.join(rows.select(F.col("hash").alias("parent")), "parent", "left_semi"), "known")
        inner = rows.join(links.select(F.col("parent").alias("hash")).distinct(), "hash", "left_semi").select(*key)
        inner = written(numbered(inner, key, "id")[0].select("hash", "id"), "inner")
        ids = links.join(inner.select(F.col("hash").alias("parent"), F.col("id").alias("parent_id")), "parent")
        pairs = ids.join(inner, "hash").select("id", "parent_id").unionByName(inner.select("id", F.lit(-1).cast("long").alias("parent_id")))
        placed = pairs.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_in_order(), "id long, place long")
        placed = written(inner.join(placed, "id").select(F.col("hash").alias("parent"), "place"), "places")
        # an entry on a cycle, or after one, has no place
        last = links.join(placed, "parent", "left").groupBy("hash").agg(F.max("place").alias("place"), F.count_if(F.col("place").isNull()).alias("open"))
        free = rows.select(*key).join(last, "hash", "left").where(F.coalesce("open", F.lit(0)) == 0).withColumn("place", F.coalesce("place", F.lit(-1)))
        return numbered(free.drop("open"), ["place", *key], "pos")[0].select("hash", F.col("pos").cast("long").alias("pos"))

    # -- growth -------------------------------------------------------------

    def merged(self, other: DataFrame) -> OpLog:
        """The union, each hash once."""
        return OpLog(self.df.unionByName(other.select(*ENTRY_NAMES)).dropDuplicates(["hash"]))

    # -- graphs -------------------------------------------------------------

    def materialize(self, ontology: Ontology | None = None, **options) -> replay.Materialized:
        return replay.materialize(self.df, ontology, **options)

    def graph(self, ontology: Ontology | None = None, **options) -> Graph:
        m = self.materialize(ontology, **options)
        return Graph(m.nodes, m.edges, m.ontology)

    def as_of(self, physical_ms: int, logical: int = 0) -> OpLog:
        """The entries up to a clock, that one included."""
        cut = (F.col("physical_ms") < physical_ms) | (F.col("physical_ms") == physical_ms) & (F.col("logical") <= logical)
        return OpLog(self.df.where(cut))

    def snapshot_at(self, physical_ms: int, logical: int = 0) -> Graph:
        past = self.as_of(physical_ms, logical)
        m = past.materialize()
        return Graph(m.nodes, m.edges, m.ontology, cutoff_clock=(physical_ms, logical))


def with_logical(df: DataFrame, by: str, order: str) -> DataFrame:
    """Logical clocks for rows that share a millisecond."""
    return df.withColumn("logical", (F.row_number().over(W.partitionBy(by).orderBy(order)) - 1).cast("int"))


def with_hash(df: DataFrame, named: bool = False) -> DataFrame:
    """Rows in the log's layout, absent columns null, with their hashes; those that are there stay. ``named``: all are there, so no other column is needed for them."""
    kept = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in layout()]
    out = df.select(*kept).withColumn("next", F.coalesce("next", F.array().cast("array<string>")))
    return (out if named else out.withColumn("hash", F.coalesce("hash", entry_hash()))).select(*ENTRY_NAMES)
