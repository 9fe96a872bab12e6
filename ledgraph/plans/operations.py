"""Registered queries of what works on logs and stores: writes, replication, compaction, schemas, streams."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import HybridClock
from ..functions.schema import ENTRY_NAMES
from ..functions.scratch import scratch_dir, written
from ..operators import compact, signing, sync, traverse
from ..operators.ontology import Ontology, OntologyError, enforced_constraint_names
from ..operators.oplog import OpLog, entry_hash, hash_of, with_hash
from ..operators.query import Query
from ..sources.buffer import OperationBuffer
from ..sources.fixtures import DAY, STAR, USERS, content_log, event_log, observations, star_graph, user_graph
from ..sources.store import GraphStore, ValidationError
from .catalog import _CUT, _EDGE_LOG, _OBS, EDGES, LOG, NODES, _count, _cut, _flat, _replayed, _shown, _walk, _with_edges, query

# Entries of the content log with the day's first entry of each author, and how many days the author had before.
CLOG = f"""{LOG}, clog AS (SELECT *, ms // {DAY} AS day, row_number() OVER (PARTITION BY author, ms // {DAY} ORDER BY ms, lg) = 1 AS first,
  dense_rank() OVER (PARTITION BY author ORDER BY ms // {DAY}) AS di, CASE event_type WHEN 'signup' THEN 'add_node' WHEN 'error' THEN 'remove_node' ELSE 'update_property' END AS op FROM log)"""
LAST = "last AS (SELECT author, max(row(ms, lg)) AS latest FROM clog GROUP BY author)"


def _values(columns: str, *rows: tuple) -> str:
    """SQL of fixed rows."""
    def shown(x: object) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({columns})"


def _head(log: OpLog, *authors: str) -> list[str]:
    """The last entry of each author."""
    last = log.df.where(F.col("author").isin(*authors) & (F.col("op") != "define_ontology")).groupBy("author").agg(F.max_by("hash", F.struct("physical_ms", "logical")).alias("hash"))
    return [r["hash"] for r in last.collect()]


def _refused(f, *kinds: type[Exception]) -> str:
    try:
        f()
    except kinds as e:
        return str(e)
    return "accepted"


# -- the log ----------------------------------------------------------------


@query(f"WITH {CLOG} SELECT author, ms AS physical_ms, op FROM clog WHERE author = 'a2' ORDER BY ms, lg LIMIT 1")
def get_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = content_log(spark, sf_dir)
    first = log.df.where("author = 'a2'").orderBy("physical_ms", "logical").first()["hash"]
    return log.get(first).select("author", "physical_ms", "op")


@query("SELECT count(*) + 1 AS entries FROM events")
def log_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(content_log(spark, sf_dir).count(),)], "entries long")


def _unseen(*authors: str) -> str:
    names = ", ".join(f"'{a}'" for a in authors)
    return f"WITH {CLOG}, {LAST} SELECT clog.author, count(*) AS n FROM clog JOIN last USING (author) WHERE NOT (author IN ({names}) AND (first OR row(ms, lg) = latest)) GROUP BY clog.author"


@query(_unseen("a1"))
def entries_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the head of one author has not seen."""
    log = content_log(spark, sf_dir)
    return _count(log.entries_since(_head(log, "a1")[0]), "author")


@query(_unseen("a0", "a2"))
def entries_since_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = content_log(spark, sf_dir)
    return _count(log.entries_since(_head(log, "a0", "a2")), "author")


@query(_values("cursor, known", ("heads", True), ("half", False), ("none", True)))
def heads_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = content_log(spark, sf_dir)
    heads = _head(log, "a0", "a3")
    return spark.createDataFrame([("heads", log.heads_known(heads)), ("half", log.heads_known([*heads, "0" * 64])), ("none", log.heads_known([]))], "cursor string, known boolean")


@query(f"WITH {CLOG}, {LAST} SELECT clog.author, count(*) AS n FROM clog JOIN last USING (author) WHERE first OR row(ms, lg) = latest GROUP BY clog.author UNION ALL SELECT 'genesis', 1")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the four last entries build on."""
    log = content_log(spark, sf_dir)
    heads = spark.createDataFrame([(h,) for h in _head(log, "a0", "a1", "a2", "a3")], "hash string")
    seen = log.df.join(traverse.ancestors(log.links, heads), "hash", "left_semi")
    return _count(seen.withColumn("author", F.when(F.col("op") == "define_ontology", "genesis").otherwise(F.col("author"))), "author")


@query("SELECT count(*) AS entries, CAST(0 AS BIGINT) AS violations FROM (SELECT event_id FROM events UNION ALL SELECT -1)")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes are those of the contents, parents are there, no entry is there twice."""
    log = content_log(spark, sf_dir)
    return spark.createDataFrame([(log.count(), log.violations().count())], "entries long, violations long")


@query(
    f"""WITH {CLOG}, lost AS (SELECT author, max(di) AS di FROM clog WHERE first AND author = 'a3' GROUP BY author),
 left_ AS (SELECT clog.* FROM clog LEFT JOIN lost ON clog.author = lost.author AND clog.di = lost.di AND clog.first WHERE lost.author IS NULL)
 SELECT 'hash does not fit the content' AS problem, count(*) AS n FROM left_ WHERE op = 'update_property' AND ms % 100 = 7
 UNION ALL SELECT 'parent is absent', count(*) FROM left_ JOIN lost USING (author, di)
 UNION ALL SELECT 'hash is repeated', count(*) FROM left_ WHERE op = 'add_node' AND ms % 10 = 3"""
)
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with changed values, without an author's last day's first entry, and with entries twice over."""
    log = OpLog(written(content_log(spark, sf_dir).df, "log"))
    days = log.df.where("author = 'a3' and op != 'define_ontology'").groupBy(F.floor(F.col("physical_ms") / DAY).alias("day")).agg(F.min_by("hash", F.struct("physical_ms", "logical")).alias("hash"))
    gone = days.orderBy(F.desc("day")).first()["hash"]
    left = log.df.where(F.col("hash") != gone)
    other = F.when((F.col("op") == "update_property") & (F.col("physical_ms") % 100 == 7), "tampered").otherwise(F.col("key"))
    torn = left.withColumn("key", other).unionByName(left.where("op = 'add_node' and physical_ms % 10 = 3"))
    return _count(OpLog(written(torn, "torn")).violations(), "problem")


@query("SELECT count(*) + 1 AS fit FROM events")
def entry_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_log(spark, sf_dir).df.where(F.col("hash") == entry_hash()).agg(F.count("*").alias("fit"))


# By levels; within one, by the parent's place (that of its author's first entry), then by clock.
_PLACED = f"""{CLOG}, rank AS (SELECT author, row_number() OVER (ORDER BY min(row(ms, lg))) AS r FROM clog GROUP BY author),
 placed AS (SELECT clog.*, row(CASE WHEN first THEN di ELSE di + 1 END, r, ms, lg) AS pos FROM clog JOIN rank USING (author))"""


@query(f"WITH {_PLACED} SELECT author, ms AS physical_ms, CAST(lg AS INTEGER) AS logical, row_number() OVER (ORDER BY pos) AS place FROM placed")
def oplog_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's topological order; the genesis has place 0."""
    log = content_log(spark, sf_dir)
    return log.df.join(log.causal_positions(), "hash").where("op != 'define_ontology'").select("author", "physical_ms", "logical", F.col("pos").alias("place"))


@query(
    f"""WITH {_PLACED}, ident AS (SELECT id, min(CASE WHEN op = 'add_node' THEN pos END) AS first_pos, max(CASE WHEN op = 'add_node' THEN pos END) AS last_pos, max(CASE WHEN op = 'add_node' THEN row(ms, lg) END) AS add_clock,
   max(CASE WHEN op = 'remove_node' THEN pos END) AS rm_pos, arg_max(row(ms, lg), pos) FILTER (op = 'remove_node') AS rm_clock FROM placed GROUP BY id HAVING count(*) FILTER (op = 'add_node') > 0),
 state AS (SELECT id, first_pos, NOT coalesce(rm_pos > last_pos AND rm_clock > add_clock, false) AS live FROM ident),
 writes AS (SELECT id, 'value' AS key, value AS v, row(ms, lg) AS stamp FROM placed WHERE op = 'add_node' UNION ALL SELECT id, 'k', CAST(k AS DOUBLE), row(ms, lg) FROM placed WHERE op = 'add_node'
   UNION ALL SELECT p.id, p.event_type, p.value, row(p.ms, p.lg) FROM placed p JOIN state USING (id) WHERE p.op = 'update_property' AND p.pos > state.first_pos)
 SELECT id AS node_id, key, arg_max(v, stamp) AS v FROM writes JOIN state USING (id) WHERE live GROUP BY id, key"""
)
def replay_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay in the order of the DAG."""
    log = content_log(spark, sf_dir)
    return _flat(log.materialize(order="causal", positions=log.causal_positions()).nodes)


@query(f"WITH {_replayed()} SELECT id AS node_id, live FROM state")
def reserved_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that are reserved have no effect."""
    log = event_log(spark, sf_dir)
    lens = spark.range(50).select(F.lit("a0").alias("author"), F.lit("a0").alias("clock_id"), (F.col("id") + 1).alias("physical_ms"), F.lit(0).alias("logical"), F.lit("define_lens").alias("op"), F.concat(F.lit("u:"), "id").alias("node_id"))
    return OpLog(log.df.unionByName(with_hash(lens))).materialize().nodes.select("node_id", "live")


@query(f"WITH {_replayed()} SELECT 'k is not of type int' AS reason, 'update_property' AS op, count(*) AS n FROM l JOIN state USING (id) WHERE event_type = 'click' AND pos > first_pos")
def update_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of a declared property by values of another kind; those that come before their node are no matter."""
    log = event_log(spark, sf_dir)
    wrong = log.df.withColumn("key", F.when(F.col("key") == "click", "k").otherwise(F.col("key")))
    return _count(OpLog(wrong).materialize().quarantine, "reason", "op")


@query(
    f"""WITH {LOG}, {_EDGE_LOG} SELECT CASE WHEN u % 10 = 0 THEN 'unknown edge type: LIKES' WHEN u NOT IN (SELECT u FROM adds) THEN 'source node not found' ELSE 'target node not found' END AS reason, count(*) AS n, true AS sorted
 FROM wanted WHERE u % 10 = 0 OR u NOT IN (SELECT u FROM adds) OR u + 1 NOT IN (SELECT u FROM adds) GROUP BY 1"""
)
def store_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's quarantined entries, ordered by hash."""
    store = GraphStore.from_snapshot(spark, "me", written(_with_edges(spark, sf_dir).df, "log"))
    found = written(store.get_quarantined().withColumn("_at", F.monotonically_increasing_id()), "quarantine")
    ends = found.groupBy(F.spark_partition_id()).agg(F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.min_by("hash", "_at").alias("first"), F.max_by("hash", "_at").alias("last"), F.min("_at").alias("at")).orderBy("at").collect()
    fits = all(r["lo"] == r["first"] and r["hi"] == r["last"] for r in ends) and all(a["hi"] <= b["lo"] for a, b in zip(ends, ends[1:], strict=False))
    return _count(found, "reason").withColumn("sorted", F.lit(fits))


@query(f"WITH {LOG}, {_EDGE_LOG} SELECT count(*) AS n FROM wanted WHERE u % 10 = 0 AND u IN (SELECT u FROM adds) AND u + 1 IN (SELECT u FROM adds)")
def revalidate_freed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an extension of the schema frees from quarantine."""
    store = GraphStore.from_snapshot(spark, "me", written(_with_edges(spark, sf_dir).df, "log"))
    store.extend_ontology({"edge_types": {"LIKES": {"source_types": ["user"], "target_types": ["user"]}}})
    return spark.createDataFrame([(store.revalidate(),)], "n long")


# -- stores -----------------------------------------------------------------


def _places(spark: SparkSession, sf_dir: str, store: GraphStore) -> GraphStore:
    """Regions and nations (tables of fixed size) by single writes."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    for r in read("region"):
        store.add_node(f"r:{r['r_regionkey']}", "region", r["r_name"])
    for n in read("nation"):
        store.add_node(f"n:{n['n_nationkey']}", "nation", n["n_name"], {"rank": n["n_nationkey"]})
        store.add_edge(f"nr:{n['n_nationkey']}", "IN_REGION", f"n:{n['n_nationkey']}", f"r:{n['n_regionkey']}")
    return store


_PLACES = "SELECT 'n:' || n_nationkey AS node_id, 'nation' AS node_type, CAST(NULL AS VARCHAR) AS subtype, n_name AS label FROM nation UNION ALL SELECT 'r:' || r_regionkey, 'region', NULL, r_name FROM region"


@query(f"SELECT * FROM ({_PLACES}) WHERE node_id != 'n:3'")
def store_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _places(spark, sf_dir, GraphStore(spark, "me", STAR))
    store.remove_node("n:3")
    store.remove_node("n:absent")
    return _shown(store.graph().all_nodes())


@query("SELECT 'nr:' || n_nationkey AS edge_id, 'n:' || n_nationkey AS source_id, 'r:' || n_regionkey AS target_id FROM nation WHERE n_nationkey NOT IN (3, 4)")
def store_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _places(spark, sf_dir, GraphStore(spark, "me", STAR))
    store.remove_node("n:3")
    store.remove_edge("nr:4")
    return store.graph().all_edges().select("edge_id", "source_id", "target_id")


@query("SELECT 'n:' || n_nationkey AS node_id, CASE WHEN n_nationkey < 5 THEN n_nationkey + 100 ELSE n_nationkey END AS rank FROM nation")
def store_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _places(spark, sf_dir, GraphStore(spark, "me", STAR))
    for i in range(5):
        store.update_property(f"n:{i}", "rank", i + 100)
    store.update_property("nobody", "rank", 1)
    from ..functions.values import prop

    return store.graph().query_nodes_by_type("nation").select("node_id", prop("rank", "int").cast("int").alias("rank"))


@query("SELECT 'o:' || o_orderkey AS node_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders")
def store_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk append of all orders: consecutive clocks in the given order, and every node is there."""
    store = GraphStore(spark, "me", STAR)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.col("o_orderkey").alias("seq"), F.lit("add_node").alias("op"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node_id"), F.lit("order").alias("node_type"), F.col("o_orderstatus").alias("subtype"), F.lit("x").alias("label"))
    store.append_ops(rows)
    clocks = store.log.df.where("op = 'add_node'").select("node_id", "logical")
    least = clocks.agg(F.min("logical")).first()[0]
    return store.graph().all_nodes().join(clocks, "node_id").select("node_id", (F.col("logical") - least).cast("long").alias("place"))


@query(f"{_PLACES}")
def store_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, reopened, exported and taken up as a snapshot."""
    import uuid

    path = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    _places(spark, sf_dir, GraphStore(spark, "me", STAR, path, codec="zstd")).flush()
    again = GraphStore.open(spark, path)
    return _shown(GraphStore.from_snapshot(spark, "you", again.snapshot()).graph().all_nodes())


@query(_values("mode, waiting, stored", ("deferred", 2, 0), ("flushed", 0, 2), ("immediate", 0, 3)))
def store_flush_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    store = GraphStore(spark, "me", STAR, path)
    store.add_node("r:0", "region", "R")
    rows = [("deferred", store.pending_flush_count(), 0)]
    rows.append(("flushed", 0, store.flush()))
    store.set_flush_mode("immediate")
    store.add_node("r:1", "region", "R")
    rows.append(("immediate", store.pending_flush_count(), spark.read.parquet(path).count()))
    return spark.createDataFrame(rows, "mode string, waiting int, stored int")


@query("SELECT count(*) + 1 AS entries, true AS smaller FROM (SELECT unnest(range(20)))")
def store_reclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty files of one write each become one."""
    import uuid

    store = GraphStore(spark, "me", STAR, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    store.set_flush_mode("immediate")
    for i in range(20):
        store.add_node(f"r:{i}", "region", "R")
    saved = store.reclaim_disk()
    return spark.createDataFrame([(len(store), saved > 0)], "entries long, smaller boolean")


@query(_values("codec, entries", ("gzip", 2), ("none", 2), ("snappy", 2), ("zstd", 2), ("zip", None)))
def store_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    rows = []
    for codec in ("gzip", "none", "snappy", "zstd"):
        path = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
        store = GraphStore(spark, "me", STAR, path, codec=codec)
        store.add_node("r:0", "region", "R")
        store.flush()
        rows.append((codec, GraphStore.open(spark, path).log.count()))
    try:
        GraphStore(spark, "me", STAR, codec="zip")
    except ValueError:
        rows.append(("zip", None))
    return spark.createDataFrame(rows, "codec string, entries int")


@query(_values("kind, name", *[("node type", n) for n in ("customer", "nation", "order", "part", "party", "place", "region", "supplier")], *[("edge type", n) for n in ("CONTAINS", "IN_NATION", "IN_REGION", "PLACED_BY", "SUPPLIES")], ("instance", "me"), ("clock is that of the last entry", "true"), ("schema", "same")))
def store_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = GraphStore(spark, "me", STAR)
    last = store.log.df.agg(F.max(F.struct("physical_ms", "logical"))).first()[0]
    rows = [("node type", n) for n in store.node_type_names()] + [("edge type", n) for n in store.edge_type_names()]
    rows += [("instance", store.instance_id), ("clock is that of the last entry", str(tuple(last) == store.clock_time()).lower()), ("schema", "same" if Ontology(store.ontology_json()).digest() == STAR.digest() else "other")]
    return spark.createDataFrame(rows, "kind string, name string")


_REFUSALS = (
    ("unknown type", "unknown node type: planet"), ("missing source", "source node 'n:9' not found"), ("unknown edge type", "unknown edge type: NEAR"), ("wrong source", "IN_REGION does not allow source type region"), ("wrong target", "IN_REGION does not allow target type nation"),
    ("kind", "acctbal is not of type float"), ("subtype", "order requires a subtype"), ("inherited kind on update", "acctbal is not of type float"), ("undeclared", "accepted"), ("unknown subtype", "accepted"),
)


@query(_values("attempt, outcome", *_REFUSALS))
def store_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = GraphStore(spark, "me", STAR)
    s.add_node("r", "region", "R")
    s.add_node("n", "nation", "N")
    s.add_node("c", "customer", "C")
    tries = (
        lambda: s.add_node("x", "planet", "X"), lambda: s.add_edge("e", "IN_REGION", "n:9", "r"), lambda: s.add_edge("e", "NEAR", "n", "r"), lambda: s.add_edge("e", "IN_REGION", "r", "r"), lambda: s.add_edge("e", "IN_REGION", "n", "n"),
        lambda: s.add_node("d", "customer", "D", {"acctbal": 1}), lambda: s.add_node("o", "order", "O"), lambda: s.update_property("c", "acctbal", "much"), lambda: s.add_node("d", "customer", "D", {"colour": "red"}), lambda: s.add_node("o", "order", "O", None, "Z"),
    )
    return spark.createDataFrame([(name, _refused(t, ValidationError)) for (name, _), t in zip(_REFUSALS, tries, strict=True)], "attempt string, outcome string")


@query(f"SELECT 'node' AS what, node_id AS id FROM ({_PLACES}) WHERE node_type = 'nation' UNION ALL SELECT 'left in the buffer', 'bad' UNION ALL SELECT 'left in the buffer', 'after'")
def buffer_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffered operations go to the store in order, up to the first that it refuses."""
    store = GraphStore(spark, "me", STAR)
    with tempfile.TemporaryDirectory() as folder:  # a buffer is a file of its writer
        buffer = OperationBuffer(str(Path(folder) / "operations.jsonl"))
        for n in spark.read.parquet(f"{sf_dir}/nation.parquet").collect():
            buffer.add_node(f"n:{n['n_nationkey']}", "nation", n["n_name"])
        buffer.add_node("bad", "planet", "X")
        buffer.add_node("after", "nation", "Y")
        _refused(lambda: buffer.drain(store), ValidationError)
        left = [r["node_id"] for r in buffer.read_all()]
    rows = [("left in the buffer", i) for i in left]
    return store.graph().all_nodes().select(F.lit("node").alias("what"), F.col("node_id").alias("id")).unionByName(spark.createDataFrame(rows, "what string, id string"))


@query(_values("input, outcome", ("mapping", "same"), ("text", "same"), ("list", "an ontology is a mapping or JSON text")))
def ontology_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = STAR.to_dict()
    rows = [(name, "same" if Ontology(x).digest() == STAR.digest() else "other") for name, x in (("mapping", spec), ("text", json.dumps(spec)))]
    return spark.createDataFrame([*rows, ("list", _refused(lambda: Ontology([]), TypeError))], "input string, outcome string")


@query(_values("step, physical_ms, logical", ("tick, clock behind", 20, 0), ("tick, clock ahead", 10, 4), ("merge, other ahead", 30, 6), ("merge, both alike", 10, 8), ("merge, now ahead", 50, 0)))
def clock_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = HybridClock("a", 10, 3)
    steps = {"tick, clock behind": c.tick(20), "tick, clock ahead": c.tick(5), "merge, other ahead": c.merge(HybridClock("b", 30, 5), 5), "merge, both alike": c.merge(HybridClock("b", 10, 7), 5), "merge, now ahead": c.merge(HybridClock("b", 30, 5), 50)}
    return spark.createDataFrame([(k, *v.as_tuple()) for k, v in steps.items()], "step string, physical_ms int, logical int")


@query(
    f"""WITH {CLOG}, f AS (SELECT author, day % 2 = 0 AS even FROM clog WHERE first) SELECT 'lenient' AS mode, author, count(*) AS n FROM f WHERE author != 'a1' OR NOT even GROUP BY author
 UNION ALL SELECT 'strict', author, count(*) FROM f WHERE author = 'a0' OR author = 'a1' AND NOT even GROUP BY author"""
)
def signed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's first entries: two authors are known and one of them forges every other day, one is unknown, one doesn't sign."""
    log = content_log(spark, sf_dir)
    days = log.df.where("op != 'define_ontology'").groupBy("author", F.floor(F.col("physical_ms") / DAY).alias("day")).agg(F.min_by("hash", F.struct("physical_ms", "logical")).alias("hash"))
    keys = {a: bytes([i]) * 32 for i, a in enumerate(("a0", "a1", "a2"))}
    made = []
    for r in days.collect():
        if r["author"] in keys:
            message = bytes.fromhex(r["hash"])[::-1] if r["author"] == "a1" and r["day"] % 2 == 0 else bytes.fromhex(r["hash"])
            made.append((r["hash"], bytearray(signing.sign(keys[r["author"]], message))))
    entries = log.df.join(days.select("hash"), "hash", "left_semi").drop("signature").join(F.broadcast(spark.createDataFrame(made, "hash string, signature binary")), "hash", "left")
    entries = written(entries, "signed")
    trusted = {a: signing.public_key(keys[a]) for a in ("a0", "a1")}
    modes = [_count(signing.accepted(entries, trusted, strict), "author").select(F.lit("strict" if strict else "lenient").alias("mode"), "author", "n") for strict in (False, True)]
    return modes[0].unionByName(modes[1])


# -- schemas ----------------------------------------------------------------


@query("SELECT 'SUPPLIES does not allow source type supplier' AS error, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'CONTAINS does not allow target type part', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'unknown edge type: IN_REGION', count(*) FROM nation")
def validate_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges judged by a schema that lets customers supply, orders contain orders, and knows no regions' edges; parties stand for suppliers and customers."""
    g = star_graph(spark, sf_dir)
    spec = STAR.to_dict()
    spec["edge_types"]["SUPPLIES"]["source_types"], spec["edge_types"]["CONTAINS"]["target_types"] = ["customer"], ["order"]
    del spec["edge_types"]["IN_REGION"]
    schema = Ontology(spec)
    kinds = {"r": "region", "n": "nation", "c": "customer", "s": "supplier", "p": "part", "o": "order"}
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    e = g.edges.where("live")
    error = schema.edge_error(F.col("edge_type"), kind[F.substring_index("source_id", ":", 1)], kind[F.substring_index("target_id", ":", 1)], F.col("properties"))
    return _count(e.select(error.alias("error")).where("error is not null"), "error")


@query("SELECT 'unknown node type: part' AS error, count(*) AS n FROM part UNION ALL SELECT 'order requires a subtype', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'missing required property due', count(*) FROM orders WHERE o_orderstatus = 'F'")
def validate_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subtype's own properties; an absent subtype, and one that isn't declared."""
    schema = Ontology({"node_types": {"order": {"subtypes": {"F": {"properties": {"due": {"value_type": "string", "required": True}}}, "O": {}}}}})
    nodes = star_graph(spark, sf_dir).all_nodes().where("node_type in ('part', 'order')")
    subtype = F.when(F.col("subtype") != "O", F.col("subtype"))
    return _count(nodes.select(schema.node_error(F.col("node_type"), subtype, F.col("properties")).alias("error")).where("error is not null"), "error")


@query("SELECT 'qty is not of type int' AS error, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'lines violates max', count(*) FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0")
def validate_edge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property of every edge as an update."""
    spec = STAR.to_dict()
    spec["edge_types"]["CONTAINS"]["properties"] = {"qty": "int", "lines": {"value_type": "int", "constraints": {"max": 1}}}
    none = F.lit(None).cast("string")
    each = star_graph(spark, sf_dir).edges.where("live").select("edge_type", F.explode("properties").alias("key", "value"))
    return _count(each.select(Ontology(spec).update_error(none, none, F.col("edge_type"), F.col("key"), F.col("value")).alias("error")).where("error is not null"), "error")


@query("SELECT 'acctbal violates min' AS error, true AS inherited, count(*) AS n FROM (SELECT c_acctbal AS b FROM customer UNION ALL SELECT s_acctbal FROM supplier) WHERE b < 0 UNION ALL SELECT 'mktsegment is not one of the allowed values', x, count(*) FROM customer, (VALUES (true), (false)) t(x) WHERE c_mktsegment != 'BUILDING' GROUP BY x")
def validate_node_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property of every party as an update, with and without what is inherited."""
    spec = STAR.to_dict()
    spec["node_types"]["party"]["properties"]["acctbal"] = {"value_type": "float", "constraints": {"min": 0}}
    spec["node_types"]["customer"]["properties"]["mktsegment"] = {"value_type": "string", "constraints": {"enum": ["BUILDING"]}}
    schema, none = Ontology(spec), F.lit(None).cast("string")
    each = star_graph(spark, sf_dir).query_nodes_by_type("party").select("node_type", F.explode("properties").alias("key", "value"))
    parts = [each.select(schema.update_error(F.col("node_type"), none, none, F.col("key"), F.col("value"), i).alias("error"), F.lit(i).alias("inherited")) for i in (True, False)]
    return _count(parts[0].unionByName(parts[1]).where("error is not null"), "error", "inherited")


_FORMS = (
    ("parent", {"node_types": {"a": {"parent_type": "b"}}}, "node type 'a' has unknown parent 'b'"),
    ("cycle", {"node_types": {"a": {"parent_type": "b"}, "b": {"parent_type": "a"}}}, "node type 'a' is its own ancestor"),
    ("end", {"edge_types": {"E": {"source_types": ["a"], "target_types": []}}}, "edge type 'E' refers to unknown node type 'a'"),
    ("constraint", {"node_types": {"a": {"properties": {"p": {"value_type": "int", "constraints": {"least": 1}}}}}}, "a.p has unknown constraint 'least'"),
    ("kind", {"node_types": {"a": {"properties": {"p": "number"}}}}, "unknown value type 'number'"),
    ("own constraint", {"node_types": {"a": {"properties": {"p": {"value_type": "int", "constraints": {"x_unit": "kg"}}}}}}, "accepted"),
)


@query(_values("form, outcome", *((a, c) for a, _, c in _FORMS)))
def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(name, _refused(lambda spec=spec: Ontology(spec), OntologyError)) for name, spec, _ in _FORMS], "form string, outcome string")


@query(_values("name", *((c,) for c in ("enum", "max", "max_exclusive", "max_length", "min", "min_exclusive", "min_length", "pattern"))))
def constraint_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in enforced_constraint_names()], "name string")


_EXTENSIONS = (
    ("new type", {"node_types": {"depot": {"parent_type": "place"}}}, "nation,depot,region,place of place"), ("new property", {"node_type_updates": {"part": {"add_properties": {"colour": "string"}}}}, "colour of part"), ("relaxed", {"node_type_updates": {"order": {"relax_properties": ["priority"]}}}, "priority optional"),
    ("wider ends", {"edge_type_updates": {"SUPPLIES": {"add_source_types": ["customer"]}}}, "supplier,customer supply"), ("empty", {}, "the extension is empty"), ("type exists", {"node_types": {"part": {}}}, "node type 'part' exists"), ("property exists", {"node_type_updates": {"part": {"add_properties": {"size": "int"}}}}, "property part.size exists"),
    ("unknown type", {"node_type_updates": {"planet": {}}}, "unknown node type 'planet'"), ("unknown key", {"types": {"a": 1}}, "unknown extension keys ['types']"), ("unknown end", {"edge_types": {"E": {"source_types": ["planet"], "target_types": []}}}, "edge type 'E' refers to unknown node type 'planet'"),
)


@query(_values("extension, outcome", *((a, c if " of place" not in c else "depot,nation,place,region of place") for a, _, c in _EXTENSIONS)))
def ontology_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    def told(name: str, spec: dict) -> str:
        try:
            o = STAR.extended(spec)
        except OntologyError as e:
            return str(e)
        return {
            "new type": lambda: f"{','.join(o.family('place'))} of place",
            "new property": lambda: f"{','.join(set(o.effective_properties('part')) - set(STAR.effective_properties('part')))} of part",
            "relaxed": lambda: f"priority {'required' if o.effective_properties('order')['priority']['required'] else 'optional'}",
            "wider ends": lambda: f"{','.join(o.edge_types['SUPPLIES']['source_types'])} supply",
        }[name]()

    return spark.createDataFrame([(name, told(name, spec)) for name, spec, _ in _EXTENSIONS], "extension string, outcome string")


@query("SELECT sha256('{\"edge_types\":{},\"node_types\":{\"a\":{\"parent_type\":null,\"properties\":{\"p\":{\"constraints\":{\"min\":1},\"required\":false,\"value_type\":\"int\"}},\"subtypes\":{}}}}') AS digest")
def ontology_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a schema's canonical text."""
    return spark.createDataFrame([(Ontology({"node_types": {"a": {"properties": {"p": {"value_type": "int", "constraints": {"min": 1}}}}}}).digest(),)], "digest string")


# The statements of the star schema, in natural order; fixed values.
_FACTS = """version:1
type:place type:region parent:region:place type:nation parent:nation:place
type:party prop:party:acctbal:float:optional
type:customer parent:customer:party prop:customer:acctbal:float:optional prop:customer:mktsegment:string:optional
type:supplier parent:supplier:party prop:supplier:acctbal:float:optional
type:part prop:part:brand:string:optional prop:part:type:string:optional prop:part:size:int:optional prop:part:retailprice:float:optional
type:order prop:order:totalprice:float:optional prop:order:priority:string:optional subtype:order:F subtype:order:O subtype:order:P
edge:IN_REGION src:IN_REGION:nation tgt:IN_REGION:region edge:IN_NATION src:IN_NATION:party tgt:IN_NATION:nation
edge:PLACED_BY src:PLACED_BY:order tgt:PLACED_BY:customer edge:CONTAINS src:CONTAINS:order tgt:CONTAINS:part edge:SUPPLIES src:SUPPLIES:supplier tgt:SUPPLIES:part"""


@query(_values("fact", *((f,) for f in _FACTS.split())))
def ontology_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAR.facts_table(spark)


# -- graphs -----------------------------------------------------------------


@query(f"SELECT node_id FROM ({_walk(EDGES, 'o:1', 6)})")
def dfs_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).dfs("o:1").select("node_id")


@query(f"WITH {NODES} SELECT 'count' AS terminal, CAST(count(*) AS VARCHAR) AS answer FROM nodes WHERE node_type = 'nation' UNION ALL SELECT 'len', CAST(count(*) AS VARCHAR) FROM nodes WHERE node_type = 'nation' UNION ALL SELECT 'first', min(node_id) FROM nodes WHERE node_type = 'nation' UNION ALL SELECT 'ids', string_agg(node_id, ',' ORDER BY node_id) FROM nodes WHERE node_type = 'region' UNION ALL SELECT 'labels', string_agg(label, ',' ORDER BY label) FROM nodes WHERE node_type = 'region' UNION ALL SELECT 'no set', '0'")
def query_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(star_graph(spark, sf_dir))
    nations, regions = q.nodes("nation"), q.nodes("region")
    rows = [("count", str(nations.count())), ("len", str(len(nations))), ("first", nations.first()["node_id"]), ("ids", ",".join(sorted(regions.collect_ids()))), ("labels", ",".join(sorted(n["label"] for n in regions))), ("no set", str(q.count()))]
    return spark.createDataFrame(rows, "terminal string, answer string")


@query("SELECT 'graph' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'view', count(*) FROM nation UNION ALL SELECT 'store', count(*) FROM nation UNION ALL SELECT 'before', 0")
def query_on_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same query over a graph, a view of it, a store and its past."""
    store = _places(spark, sf_dir, GraphStore(spark, "me", STAR))
    g = star_graph(spark, sf_dir)
    kinds = {"graph": g, "view": g.view(node_types=["nation", "region"]), "store": store.graph(), "before": store.as_of(1)}
    return spark.createDataFrame([(k, Query(x).nodes("place").follow("IN_REGION", direction="in").count()) for k, x in kinds.items()], "kind string, n long")


@query(f"SELECT {_CUT} AS physical_ms, 5 AS logical, 'me' AS instance, (SELECT count(*) FROM (WITH {_replayed(f'WHERE ms <= {_CUT}')} SELECT id FROM state WHERE live)) AS n")
def snapshot_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = GraphStore.from_snapshot(spark, "me", event_log(spark, sf_dir).df)
    past, now = store.as_of(_cut(spark, sf_dir), 5), store.graph()
    return spark.createDataFrame([(*past.cutoff_clock, now.instance_id, past.all_nodes().count())], "physical_ms long, logical int, instance string, n long")


# -- replication ------------------------------------------------------------


@query(
    f"""WITH {CLOG}, vips AS (SELECT DISTINCT id FROM clog WHERE op = 'add_node' AND CAST(substr(id, 3) AS BIGINT) % 10 = 0), kept AS (SELECT * FROM clog WHERE id IN (SELECT id FROM vips)),
 reach AS (SELECT author, max(di) AS di FROM kept GROUP BY author) SELECT author, count(*) AS n FROM (SELECT clog.author FROM clog LEFT JOIN reach USING (author) WHERE id IN (SELECT id FROM vips) OR first AND clog.di <= reach.di) GROUP BY author"""
)
def filtered_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replica that has the schema alone gets of one type: its nodes' entries, and all that they build on."""
    log = content_log(spark, sf_dir, vip=True)
    remote = OpLog(log.df.where("op = 'define_ontology'"))
    return _count(sync.filtered_missing(log, sync.offer(remote, HybridClock("b")), ["vip"]), "author")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[OpLog, OpLog]:
    log = content_log(spark, sf_dir)
    return OpLog(written(log.df.where("author != 'a3'"), "left")), OpLog(written(log.df.where("author != 'a2'"), "right"))


@query(f"WITH {LOG} SELECT author, count(*) AS n, count(*) FILTER (author = 'a3') AS fresh, CAST(0 AS BIGINT) AS again FROM (SELECT author FROM log UNION ALL SELECT 'a0') GROUP BY author")
def merge_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica takes in another one's whole log, twice."""
    left, right = _halves(spark, sf_dir)
    merged, fresh = sync.merge(left, right.df, max_entries=None)
    twice, again = sync.merge(merged, right.df, max_entries=None)
    return _count(twice.df, "author").withColumn("fresh", F.when(F.col("author") == "a3", fresh).otherwise(0).cast("long")).withColumn("again", F.lit(again).cast("long"))


@query(f"WITH {CLOG} SELECT op, count(*) AS n FROM clog WHERE author = 'a3' AND NOT first AND ms % 10 != 1 GROUP BY op")
def merge_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An author's entries, every tenth dated far in the future, and a checkpoint of another replica."""
    log = content_log(spark, sf_dir)
    df = written(log.df, "log")
    # the entries that others build on are there; leaves come anew
    parents = OpLog(df).links.select(F.col("parent").alias("hash")).distinct()
    leaves = df.where("author = 'a3'").join(parents, "hash", "left_anti")
    days = df.where("author = 'a3'").groupBy(F.floor(F.col("physical_ms") / DAY).alias("day")).agg(F.min_by("hash", F.struct("physical_ms", "logical")).alias("hash"))
    leaves = leaves.join(days.select("hash"), "hash", "left_anti")
    local = OpLog(df.join(leaves.select("hash"), "hash", "left_anti"))
    shifted = leaves.drop("hash").withColumn("physical_ms", F.when(F.col("physical_ms") % 10 == 1, F.col("physical_ms") + 10**12).otherwise(F.col("physical_ms")))
    box = spark.range(1).select(F.lit("checkpoint").alias("op"), F.lit("zz").alias("author"), F.lit("zz").alias("clock_id"), F.lit(5).cast("long").alias("physical_ms"), F.lit(0).alias("logical"))
    incoming = with_hash(shifted).unionByName(with_hash(box))
    now = df.agg(F.max("physical_ms")).first()[0]
    return _count(sync.admitted(local, incoming, instance_id="a0", now_ms=now, max_entries=None), "op")


@query(f"WITH {LOG} SELECT (row_number() OVER (ORDER BY ms, lg) - 1) // 1000 AS message, count(*) OVER (PARTITION BY 1) AS n FROM log WHERE author = 'a2' QUALIFY row_number() OVER (ORDER BY ms, lg) % 1000 = 1")
def message_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload in messages of bounded size, and all its entries."""
    left, right = _halves(spark, sf_dir)
    sent = sync.messages(sync.missing(left, sync.offer(right, HybridClock("b"))), 1000)
    sent = written(sent.select("message", "hash"), "messages")
    return _count(sent, "message").select("message", F.lit(sent.count()).cast("long").alias("n"))


@query(_values("what, outcome", ("inserted are contained", True), ("few others are", True), ("merged has both", True), ("rate must be below one", False)))
def bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = content_log(spark, sf_dir)
    half = {a: log.df.where(F.col("author") == a).select("hash") for a in ("a0", "a1")}
    n = max(df.count() for df in half.values())
    blooms = {}
    for a, df in half.items():
        blooms[a] = sync.BloomFilter(df._jdf.stat().bloomFilter("hash", 2 * max(n, 128), 0.01), n)
    some = {a: [r[0] for r in df.limit(500).collect()] for a, df in half.items()}
    inside = all(blooms["a0"].contains(h) for h in some["a0"])
    outside = sum(blooms["a0"].contains(h) for h in some["a1"]) <= len(some["a1"]) // 20
    both = blooms["a0"].merge(blooms["a1"])
    merged = all(both.contains(h) for a in some for h in some[a])
    try:
        sync.BloomFilter.empty(spark, 10, 1.5)
        rate = True
    except ValueError:
        rate = False
    return spark.createDataFrame([("inserted are contained", inside), ("few others are", outside), ("merged has both", merged), ("rate must be below one", rate)], "what string, outcome boolean")


# -- compaction -------------------------------------------------------------

_SAFETY = (("alone", True, ""), ("peer behind", False, "a peer has not synced the latest entry"), ("peer synced", True, ""), ("cursor behind", False, "subscriber s is behind"), ("cursor at the heads", True, ""), ("compacted", True, "checkpoint"))


@query(_values("case_, safe, reasons", *_SAFETY))
def compaction_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = GraphStore(spark, "me", STAR)
    first = store.add_node("r", "region", "R")
    out = []

    def ask(name: str) -> None:
        ok, reasons = store.verify_compaction_safe()
        out.append((name, ok, "; ".join(reasons)))

    ask("alone")
    store.peers.register("p")
    ask("peer behind")
    store.peers.record_sync("p", store.clock.physical_ms)
    ask("peer synced")
    store.add_node("s", "region", "S")
    store.peers.record_sync("p", store.clock.physical_ms)
    store.register_subscriber_cursor("s", [first])
    ask("cursor behind")
    store.register_subscriber_cursor("s", [r["hash"] for r in store.log.heads().collect()])
    ask("cursor at the heads")
    hash_ = store.compact()
    out.append(("compacted", hash_ is not None, store.log.df.where(F.col("hash") == hash_).first()["op"]))
    return spark.createDataFrame(out, "case_ string, safe boolean, reasons string")


@query(_values("policy, compacts", ("interval, first", True), ("interval, at once", False), ("threshold, at it", False), ("threshold, above", True)))
def compaction_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = GraphStore(spark, "me", STAR)
    store.add_node("r", "region", "R")
    every = compact.IntervalPolicy(3600)
    rows = [("interval, first", every.should_compact(store)), ("interval, at once", every.should_compact(store)), ("threshold, at it", compact.ThresholdPolicy(2).check(store) is not None)]
    return spark.createDataFrame([*rows, ("threshold, above", compact.ThresholdPolicy(1).check(store) is not None and len(store) == 1)], "policy string, compacts boolean")


# -- observations -----------------------------------------------------------


@query(f"WITH {_OBS} SELECT source, count(*) AS n, CAST(max(timestamp_ms) AS BIGINT) AS ms FROM obs GROUP BY source UNION ALL SELECT 'new', 2, 1001")
def obs_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single observations on top of all others; of the same millisecond the last counts."""
    log = observations(spark, sf_dir).append("new", 1.0, {"a": "b"}, 1000).append("new", 2.0, None, 1001).append("new", 3.0, None, 1001)
    last = log.query_latest("new").first()
    if (last["value"], _refused(lambda: log.append("x" * 70_000, 1.0), ValueError)) != (3.0, "source is too long"):
        raise AssertionError("the last write of a millisecond counts, and sources are of limited size")
    return log.df.groupBy("source").agg(F.count("*").alias("n"), F.max("timestamp_ms").alias("ms"))


@query("SELECT 'order:' || o_orderstatus AS source, 1000 + row_number() OVER (ORDER BY o_orderkey) - 1 AS timestamp_ms, o_totalprice AS value FROM orders")
def obs_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of values, each a millisecond after the one before."""
    from ..operators.obslog import ObservationLog

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = orders.select(F.concat(F.lit("order:"), "o_orderstatus").alias("source"), F.col("o_totalprice").alias("value"), none.alias("metadata"), F.col("o_orderkey").alias("place"))
    empty = ObservationLog(spark.createDataFrame([], "source string, timestamp_ms long, value double, metadata map<string,string>"))
    return empty.append_values(rows, 1000, ["place"]).df.select("source", "timestamp_ms", "value")


# -- streams ----------------------------------------------------------------


@query(f"WITH {LOG} SELECT CASE event_type WHEN 'signup' THEN 'add_node' WHEN 'error' THEN 'remove_node' ELSE 'update_property' END AS op, author = 'a0' AS local, count(*) AS n FROM log GROUP BY 1, 2 UNION ALL SELECT 'define_ontology', true, 1")
def subscribe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored log as a stream of events, each batch handed to a callback."""
    import uuid

    from ..streaming.tail import subscribe

    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    content_log(spark, sf_dir).df.write.parquet(f"{root}/log")
    q = subscribe(spark, f"{root}/log", lambda df, i: df.groupBy("op", "local").count().write.mode("overwrite").parquet(f"{root}/out/batch={i}"), f"{root}/cursor", instance_id="a0", available_now=True)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("op", "local").agg(F.sum("count").alias("n"))


@query("WITH n AS (SELECT count(*) + 1 - 5 AS k FROM events), m AS (SELECT k, k // 3 + 1 AS size FROM n) SELECT 'batch ' || i AS pull, CASE WHEN i < 3 THEN size ELSE k - 2 * size END AS n FROM m, (VALUES (1), (2), (3)) t(i) UNION ALL SELECT 'after', 0 UNION ALL SELECT 'stale', -1 UNION ALL SELECT 'closed', -1")
def tail_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that came after a cursor of five entries, in three pulls; then nothing, a stale cursor and a closed subscription."""
    from ..streaming.tail import TailSubscription

    log = OpLog(written(content_log(spark, sf_dir).df, "log"))
    # each author's first entry, whose only parent is the genesis
    genesis = log.df.where("op = 'define_ontology'").first()["hash"]
    cursor = [r["hash"] for r in log.links.where(F.col("parent") == genesis).collect()]
    firsts = log.df.where(F.col("hash").isin(cursor)).groupBy("author").agg(F.min_by("hash", F.struct("physical_ms", "logical")).alias("hash")).collect()
    tail = TailSubscription(lambda: log, [r["hash"] for r in firsts])
    size = (log.count() - 5) // 3 + 1
    rows = [(f"batch {i}", tail.next_frame(size).count()) for i in (1, 2, 3)]
    rows.append(("after", tail.next_frame(size, timeout_ms=10).count()))
    for name, t in (("stale", TailSubscription(lambda: log, ["0" * 64])), ("closed", tail)):
        tail.close() if name == "closed" else None
        try:
            rows.append((name, len(t.next_batch())))
        except (ValueError, RuntimeError):
            rows.append((name, -1))
    return spark.createDataFrame(rows, "pull string, n long")


@query("SELECT 'add_node' AS op, true AS local, count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region) UNION ALL SELECT 'add_edge', true, count(*) FROM nation UNION ALL SELECT 'add_node', false, 1")
def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callbacks for own writes and merged ones; one that fails disturbs nobody, one that has left hears nothing."""
    store, seen = GraphStore(spark, "me", STAR), []
    other = GraphStore.from_snapshot(spark, "you", store.snapshot())
    store.subscribe(lambda e: 1 / 0)
    gone = store.subscribe(lambda e: seen.append(("gone", True)))
    store.unsubscribe(gone)
    store.subscribe(lambda e: seen.append((e["op"], e["local"])))
    _places(spark, sf_dir, store)
    other.add_node("x", "region", "X")
    store.merge_sync_payload(other.receive_sync_offer(store.generate_sync_offer()))
    return _count(spark.createDataFrame(seen, "op string, local boolean"), "op", "local")


@query("SELECT count(*) AS n, true AS driver_agrees FROM (SELECT unnest(range(100)))")
def driver_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred entries hashed without Spark."""
    rows = content_log(spark, sf_dir).df.where("op != 'checkpoint'").orderBy("hash").limit(100).collect()
    fits = all(hash_of(r.asDict(recursive=True)) == r["hash"] for r in rows)
    return spark.createDataFrame([(len(rows), fits)], "n long, driver_agrees boolean")


