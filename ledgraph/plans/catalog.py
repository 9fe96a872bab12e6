"""The engine's registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..functions.values import prop
from ..operators import compact, sync
from ..operators.ontology import Ontology
from ..operators.oplog import OpLog
from ..operators.query import Query
from ..sources.fixtures import STAR, event_log, observations, star_graph, user_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NODES = """nodes AS (
  SELECT 'r:' || r_regionkey AS node_id, 'region' AS node_type, CAST(NULL AS VARCHAR) AS subtype, r_name AS label FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'nation', NULL, n_name FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'customer', NULL, c_name FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'supplier', NULL, s_name FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, 'part', NULL, p_name FROM part
  UNION ALL SELECT 'o:' || o_orderkey, 'order', o_orderstatus, 'o:' || o_orderkey FROM orders)"""
EDGES = """edges AS (
  SELECT 'nr:' || n_nationkey AS edge_id, 'IN_REGION' AS edge_type, 'n:' || n_nationkey AS source_id, 'r:' || n_regionkey AS target_id FROM nation
  UNION ALL SELECT 'cn:' || c_custkey, 'IN_NATION', 'c:' || c_custkey, 'n:' || c_nationkey FROM customer
  UNION ALL SELECT 'sn:' || s_suppkey, 'IN_NATION', 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT 'oc:' || o_orderkey, 'PLACED_BY', 'o:' || o_orderkey, 'c:' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'ol:' || l_orderkey || ':' || l_partkey, 'CONTAINS', 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'sp:' || l_suppkey || ':' || l_partkey, 'SUPPLIES', 's:' || l_suppkey, 'p:' || l_partkey FROM lineitem)"""
LOG = """log AS (
  SELECT event_id, event_type, 'u:' || user_id AS id, epoch_us(ts) // 1000 AS ms, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         'a' || (event_id % 4) AS author, row_number() OVER (PARTITION BY epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS lg FROM events)"""
USERS = """pairs AS (
  SELECT event_id, 'u:' || user_id AS source_id, lead('u:' || user_id) OVER (ORDER BY ts, event_id) AS target_id FROM events)"""


def _replayed(extra: str = "") -> str:
    """Identity, liveness and first add of each user of the log."""
    return f"""{LOG}, l AS (SELECT *, row(ms, lg) AS pos FROM log {extra}),
 ident AS (SELECT id, min(CASE WHEN event_type = 'signup' THEN pos END) AS first_pos, max(CASE WHEN event_type = 'signup' THEN pos END) AS last_add,
   max(CASE WHEN event_type = 'error' THEN pos END) AS last_rm FROM l GROUP BY id HAVING count(*) FILTER (event_type = 'signup') > 0),
 state AS (SELECT id, first_pos, last_add, last_rm IS NULL OR last_rm < last_add AS live FROM ident),
 writes AS (
   SELECT id, 'value' AS key, value AS v, pos FROM l WHERE event_type = 'signup'
   UNION ALL SELECT id, 'k', CAST(k AS DOUBLE), pos FROM l WHERE event_type = 'signup'
   UNION ALL SELECT l.id, l.event_type, l.value, l.pos FROM l JOIN state USING (id) WHERE l.event_type NOT IN ('signup', 'error') AND l.pos > state.first_pos),
 props AS (SELECT id, key, arg_max(v, pos) AS v FROM writes GROUP BY id, key)"""


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _shown(df: DataFrame) -> DataFrame:
    return df.select("node_id", "node_type", "subtype", "label")


def _edge(df: DataFrame) -> DataFrame:
    return df.select("edge_id", "edge_type", "source_id", "target_id")


def _count(df: DataFrame, *by: str) -> DataFrame:
    return (df.groupBy(*by) if by else df).agg(F.count("*").alias("n"))


# -- scans and adjacency ----------------------------------------------------


@query(f"WITH {NODES} SELECT node_type, subtype, count(*) AS n, count(DISTINCT node_id) AS ids FROM nodes GROUP BY node_type, subtype")
def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).all_nodes().groupBy("node_type", "subtype").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("ids"))


@query(f"WITH {EDGES} SELECT edge_type, count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM edges GROUP BY edge_type")
def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).all_edges().groupBy("edge_type").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), F.countDistinct("target_id").alias("targets"))


@query(f"WITH {NODES} SELECT * FROM nodes WHERE node_id = 'c:7'")
def get_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(star_graph(spark, sf_dir).get_node("c:7"))


@query(f"WITH {EDGES} SELECT * FROM edges WHERE edge_id = 'cn:7'")
def get_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(star_graph(spark, sf_dir).get_edge("cn:7"))


@query(f"WITH {NODES} SELECT * FROM nodes WHERE node_type IN ('customer', 'supplier')")
def nodes_by_type_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(star_graph(spark, sf_dir).query_nodes_by_type("party"))


@query(f"WITH {NODES} SELECT * FROM nodes WHERE subtype = 'P'")
def nodes_by_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(star_graph(spark, sf_dir).query_nodes_by_subtype("P"))


@query("SELECT 'p:' || p_partkey AS node_id, 'part' AS node_type, CAST(NULL AS VARCHAR) AS subtype, p_name AS label FROM part WHERE p_size = 15")
def nodes_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(star_graph(spark, sf_dir).query_nodes_by_property("size", 15))


@query(f"WITH {EDGES} SELECT * FROM edges WHERE source_id = 'o:1'")
def outgoing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(star_graph(spark, sf_dir).outgoing_edges("o:1"))


@query(f"WITH {EDGES} SELECT * FROM edges WHERE target_id = 'n:3'")
def incoming_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(star_graph(spark, sf_dir).incoming_edges("n:3"))


@query(f"WITH {USERS} SELECT target_id AS node_id FROM pairs WHERE source_id = 'u:1' AND target_id IS NOT NULL")
def neighbors_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).neighbors("u:1")


@query(f"WITH {USERS} SELECT source_id AS node_id FROM pairs WHERE target_id = 'u:1'")
def reverse_neighbors_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).reverse_neighbors("u:1")


@query(f"WITH {EDGES} SELECT source_id AS node_id, count(*) AS n FROM edges GROUP BY source_id")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(star_graph(spark, sf_dir).all_edges().select(F.col("source_id").alias("node_id")), "node_id")


# -- fluent queries and views -----------------------------------------------

def _rich() -> Column:
    return prop("acctbal", "float") > 9500


@query("SELECT DISTINCT 'r:' || r_regionkey AS node_id, r_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 9500")
def follow_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(star_graph(spark, sf_dir)).nodes("supplier").where_fn(_rich()).follow("IN_NATION").follow("IN_REGION").to_df().select("node_id", "label")


@query("SELECT 'c:' || c_custkey AS node_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def query_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(star_graph(spark, sf_dir)).nodes("customer").where(mktsegment="BUILDING").to_df().select("node_id")


@query("SELECT 'p:' || p_partkey AS node_id FROM part WHERE p_size = 7")
def query_where_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers compare by value: 7.0 finds the integer 7."""
    return Query(star_graph(spark, sf_dir)).nodes("part").where(size=7.0).to_df().select("node_id")


@query("SELECT DISTINCT 'c:' || o_custkey AS node_id FROM orders WHERE o_totalprice > 300000")
def query_follow_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(star_graph(spark, sf_dir)).nodes("order").where_fn(prop("totalprice", "float") > 300000).follow("PLACED_BY").to_df().select("node_id")


@query("SELECT DISTINCT 'o:' || o_orderkey AS node_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9500")
def query_follow_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(star_graph(spark, sf_dir)).nodes("customer").where_fn(_rich()).follow("PLACED_BY", direction="in").to_df().select("node_id")


@query(f"WITH {EDGES}, s AS (SELECT 'n:' || n_nationkey AS id FROM nation WHERE n_nationkey < 3) SELECT target_id AS node_id FROM edges WHERE source_id IN (SELECT id FROM s) UNION SELECT source_id FROM edges WHERE target_id IN (SELECT id FROM s)")
def query_follow_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(star_graph(spark, sf_dir)).nodes("nation").where_fn(F.substring_index("node_id", ":", -1).cast("int") < 3).follow(direction="both").to_df().select("node_id")


@query(f"WITH {EDGES} SELECT edge_id, source_id, target_id FROM edges WHERE edge_type = 'SUPPLIES'")
def query_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(star_graph(spark, sf_dir)).edges("SUPPLIES").to_df().select("edge_id", "source_id", "target_id")


@query(f"WITH {NODES} SELECT * FROM nodes WHERE node_type = 'order' ORDER BY node_id LIMIT 10")
def limit_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(Query(star_graph(spark, sf_dir)).nodes("order").limit(10).to_df())


@query(f"WITH {NODES} SELECT node_type, count(*) AS n FROM nodes WHERE node_type IN ('customer', 'order') GROUP BY node_type")
def view_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(star_graph(spark, sf_dir).view(node_types=["customer", "order"]).all_nodes(), "node_type")


@query(f"WITH {EDGES} SELECT edge_id, edge_type, source_id, target_id FROM edges WHERE edge_type IN ('PLACED_BY')")
def view_edges_both_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(star_graph(spark, sf_dir).view(node_types=["customer", "order"]).all_edges())


@query("SELECT 's:' || s_suppkey AS node_id FROM supplier WHERE s_acctbal > 9500 UNION ALL SELECT 'c:' || c_custkey FROM customer WHERE c_acctbal > 9500")
def view_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).view(predicate=_rich()).all_nodes().select("node_id")


@query("SELECT n_name AS label, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def raw_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.query import SqlEngine

    text = "SELECT t.label, count(*) AS n FROM nodes s JOIN edges e ON s.node_id = e.source_id JOIN nodes t ON t.node_id = e.target_id WHERE s.node_type = 'customer' AND t.node_type = 'nation' GROUP BY t.label"
    return Query(star_graph(spark, sf_dir), SqlEngine()).raw(text)


# -- traversals -------------------------------------------------------------


def _walk(edges: str, start: str, bound: int, node: str = "target_id", near: str = "source_id", where: str = "true") -> str:
    return f"""WITH RECURSIVE {edges}, w(node_id, depth) AS (
  SELECT '{start}', 0 UNION SELECT e.{node}, w.depth + 1 FROM w JOIN {"edges" if edges is EDGES else "pairs"} e ON e.{near} = w.node_id WHERE w.depth < {bound} AND e.{node} IS NOT NULL AND {where})
SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node_id"""


@query(_walk(EDGES, "o:1", 6))
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).bfs("o:1")


@query(_walk(EDGES, "s:1", 6, where="e.edge_type = 'IN_NATION'"))
def bfs_edge_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).bfs("s:1", edge_type="IN_NATION")


@query(_walk(USERS, "u:1", 2))
def bfs_max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).bfs("u:1", max_depth=2)


@query(_walk(EDGES, "r:1", 6, node="source_id", near="target_id"))
def impact_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).impact_analysis("r:1")


@query(f"SELECT CAST(min(depth) AS INTEGER) AS length FROM ({_walk(EDGES, 'o:1', 6)}) WHERE node_id = (SELECT 'r:' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 1)")
def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    end = g.bfs("o:1").where(F.col("node_id").startswith("r:")).orderBy("node_id").first()
    path = g.shortest_path("o:1", end["node_id"]) if end else None
    return spark.createDataFrame([(None if path is None else len(path) - 1,)], "length int")


_AROUND = f"""WITH RECURSIVE {EDGES}, arcs AS (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges),
 w(node_id, depth) AS (SELECT 'o:1', 0 UNION SELECT arcs.b, w.depth + 1 FROM w JOIN arcs ON arcs.a = w.node_id WHERE w.depth < 2),
 d AS (SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node_id)"""


@query(f"{_AROUND} SELECT node_id, depth FROM d")
def subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).subgraph("o:1", 2)[0]


@query(f"{_AROUND} SELECT edge_id, edge_type, source_id, target_id FROM edges WHERE source_id IN (SELECT node_id FROM d WHERE depth < 2) OR target_id IN (SELECT node_id FROM d WHERE depth < 2)")
def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(star_graph(spark, sf_dir).subgraph("o:1", 2)[1])


@query("SELECT 's:' || s_suppkey AS n0, 'n:' || n_nationkey AS n1, 'r:' || n_regionkey AS n2 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'c:' || c_custkey, 'n:' || n_nationkey, 'r:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def pattern_match_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).pattern_match(["party", "nation", "region"], max_results=None)


@query(f"WITH {USERS} SELECT a.source_id AS n0, a.target_id AS n1, b.target_id AS n2 FROM pairs a JOIN pairs b ON a.target_id = b.source_id WHERE a.source_id != a.target_id AND b.target_id NOT IN (a.source_id, a.target_id) ORDER BY n0, n1, n2 LIMIT 1000")
def pattern_match_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).pattern_match(["user", "user", "user"])


@query(
    f"""WITH RECURSIVE {NODES}, {EDGES}, w(node_id, level) AS (SELECT node_id, 0 FROM nodes UNION SELECT e.target_id, w.level + 1 FROM w JOIN edges e ON e.source_id = w.node_id),
 l AS (SELECT node_id, max(level) AS level FROM w GROUP BY node_id) SELECT CAST(level AS INTEGER) AS level, count(*) AS n FROM l GROUP BY level"""
)
def topo_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(star_graph(spark, sf_dir).topological_levels(), "level")


@query("SELECT 'star' AS graph, false AS cyclic UNION ALL SELECT 'users', true")
def has_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("star", star_graph(spark, sf_dir).has_cycle()), ("users", user_graph(spark, sf_dir).has_cycle())]
    return spark.createDataFrame(rows, "graph string, cyclic boolean")


# -- replay -----------------------------------------------------------------


def _flat(nodes: DataFrame) -> DataFrame:
    """(node_id, key, v) of live nodes, numbers as double."""
    each = nodes.where("live").select("node_id", F.explode("properties").alias("key", "value"))
    return each.select("node_id", "key", F.col("value.lit").cast("double").alias("v"))


def _stored(log: OpLog) -> OpLog:
    """The log as a table of its own, as in a store, so that its clocks are computed once; replay by clocks needs no parents."""
    return OpLog(written(log.df.withColumn("next", F.array().cast("array<string>")), "log"))


@query(f"WITH {_replayed()} SELECT props.id AS node_id, key, v FROM props JOIN state USING (id) WHERE live")
def replay_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stored(event_log(spark, sf_dir)).materialize().nodes)


@query(f"WITH {_replayed()} SELECT id AS node_id, live FROM state")
def replay_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).materialize().nodes.select("node_id", "live")


@query(f"WITH {_replayed()} SELECT id AS node_id, id AS label, 'user' AS node_type FROM state WHERE live")
def replay_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).graph().all_nodes().select("node_id", "label", "node_type")


@query(f"WITH {_replayed()} SELECT ident.id AS node_id FROM ident JOIN l USING (id) WHERE event_type = 'error' AND pos > first_pos AND (last_rm < last_add) GROUP BY ident.id")
def resurrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that live again after a remove that followed their first add."""
    log = event_log(spark, sf_dir)
    m = log.materialize()
    firsts = m.operations.where("op = 'add_node'").groupBy("node_id").agg(F.min("pos").alias("first_pos"))
    removed = m.operations.where("op = 'remove_node'").join(firsts, "node_id").where(F.col("pos") > F.col("first_pos")).select("node_id")
    return m.nodes.where("live").select("node_id").join(removed, "node_id", "left_semi")


# edges of the log: every update also adds an edge between its user and the user of the same number plus one
_EDGE_LOG = """adds AS (SELECT DISTINCT CAST(substr(id, 3) AS BIGINT) AS u FROM log WHERE event_type = 'signup'),
 ids AS (SELECT DISTINCT CAST(substr(id, 3) AS BIGINT) AS u FROM log),
 wanted AS (SELECT 'x:' || u AS edge_id, 'u:' || u AS source_id, 'u:' || (u + 1) AS target_id, u FROM ids)"""


def _with_edges(spark: SparkSession, sf_dir: str) -> OpLog:
    """The event log with one edge entry from each user to the next number, before all else: they wait for their ends."""
    from ..operators.oplog import with_hash

    log = event_log(spark, sf_dir)
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    u, v = F.concat(F.lit("u:"), "user_id"), F.concat(F.lit("u:"), (F.col("user_id") + 1).cast("string"))
    edges = users.select(
        F.sha2(F.concat(F.lit("edge"), F.col("user_id").cast("string")), 256).alias("hash"), F.lit("a0").alias("author"), F.lit("a0").alias("clock_id"), F.lit(1).cast("long").alias("physical_ms"), F.col("user_id").cast("int").alias("logical"),
        F.lit("add_edge").alias("op"), F.concat(F.lit("x:"), "user_id").alias("edge_id"), F.when(F.col("user_id") % 10 == 0, "LIKES").otherwise("NEXT").alias("edge_type"), u.alias("source_id"), v.alias("target_id"),
    )
    return OpLog(log.df.unionByName(with_hash(edges)))


@query(f"WITH {LOG}, {_EDGE_LOG} SELECT edge_id, source_id, target_id FROM wanted WHERE u % 10 != 0 AND u IN (SELECT u FROM adds) AND u + 1 IN (SELECT u FROM adds)")
def pending_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that came before their ends and hold once both were added."""
    return _with_edges(spark, sf_dir).materialize().edges.select("edge_id", "source_id", "target_id")


@query(
    f"""WITH {LOG}, {_EDGE_LOG} SELECT CASE WHEN u % 10 = 0 THEN 'unknown edge type: LIKES' WHEN u NOT IN (SELECT u FROM adds) THEN 'source node not found' ELSE 'target node not found' END AS reason, count(*) AS n
 FROM wanted WHERE u % 10 = 0 OR u NOT IN (SELECT u FROM adds) OR u + 1 NOT IN (SELECT u FROM adds) GROUP BY 1"""
)
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(_with_edges(spark, sf_dir).materialize().quarantine, "reason")


# -- validation -------------------------------------------------------------


def _validated(spark: SparkSession, sf_dir: str, node_type: str, constraint: str, spec: dict) -> DataFrame:
    g = star_graph(spark, sf_dir)
    schema = Ontology({"node_types": {node_type: {"properties": {constraint: spec}}}})
    nodes = g.query_nodes_by_type(node_type)
    if constraint == "label":
        nodes = nodes.withColumn("properties", F.create_map(F.lit("label"), F.struct(F.lit("string").alias("kind"), F.col("label").alias("lit"))))
    error = schema.node_error(F.col("node_type"), F.lit(None).cast("string"), F.col("properties"))
    return nodes.select("node_id", error.alias("error")).where("error is not null")


@query("SELECT 'c:' || c_custkey AS node_id, 'mktsegment is not one of the allowed values' AS error FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def validate_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir, "customer", "mktsegment", {"value_type": "string", "constraints": {"enum": ["BUILDING", "MACHINERY"]}})


@query("SELECT 'p:' || p_partkey AS node_id, CASE WHEN p_size < 10 THEN 'size violates min' ELSE 'size violates max_exclusive' END AS error FROM part WHERE p_size < 10 OR p_size >= 40")
def validate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir, "part", "size", {"value_type": "int", "constraints": {"min": 10, "max_exclusive": 40}})


@query("SELECT 'p:' || p_partkey AS node_id, CASE WHEN strlen(p_name) < 9 THEN 'label violates min_length' ELSE 'label violates max_length' END AS error FROM part WHERE strlen(p_name) < 9 OR strlen(p_name) > 12")
def validate_length_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir, "part", "label", {"value_type": "string", "constraints": {"min_length": 9, "max_length": 12}})


@query("SELECT 'p:' || p_partkey AS node_id, 'brand violates pattern' AS error FROM part WHERE NOT regexp_matches(p_brand, '[12]$')")
def validate_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir, "part", "brand", {"value_type": "string", "constraints": {"pattern": "[12]$"}})


@query("SELECT 's:' || s_suppkey AS node_id, 'missing required property mktsegment' AS error FROM supplier")
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir, "supplier", "mktsegment", {"value_type": "string", "required": True})


@query("SELECT 'p:' || p_partkey AS node_id, 'retailprice is not of type int' AS error FROM part WHERE p_retailprice IS NOT NULL")
def validate_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir, "part", "retailprice", {"value_type": "int"})


# -- time travel ------------------------------------------------------------

_CUT = "(SELECT CAST(avg(epoch_us(ts) // 1000) AS BIGINT) FROM events)"


def _cut(spark: SparkSession, sf_dir: str) -> int:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # as DuckDB rounds: half away from zero
    return int(events.agg(F.round(F.avg(F.unix_millis(F.col("ts").cast("timestamp"))), 0)).first()[0])


@query(f"WITH {_replayed(f'WHERE ms <= {_CUT}')} SELECT id AS node_id, live FROM state")
def as_of_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).as_of(_cut(spark, sf_dir), 1 << 30).materialize().nodes.select("node_id", "live")


@query(f"WITH {_replayed(f'WHERE ms <= {_CUT}')} SELECT props.id AS node_id, key, v FROM props JOIN state USING (id) WHERE live")
def as_of_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stored(event_log(spark, sf_dir)).snapshot_at(_cut(spark, sf_dir), 1 << 30).nodes)


# -- the log ----------------------------------------------------------------


@query(f"WITH {LOG} SELECT author, max(ms) AS physical_ms FROM log GROUP BY author")
def oplog_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return log.df.join(log.heads(), "hash", "left_semi").select("author", "physical_ms")


@query(f"WITH {LOG} SELECT author, ms AS physical_ms, CAST(lg AS INTEGER) AS logical, CASE event_type WHEN 'signup' THEN 'add_node' WHEN 'error' THEN 'remove_node' ELSE 'update_property' END AS op FROM log WHERE id = 'u:5'")
def entries_affecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).entries_affecting("u:5").select("author", "physical_ms", "logical", "op")


# -- replication ------------------------------------------------------------


def _replicas(spark: SparkSession, sf_dir: str) -> tuple[OpLog, OpLog]:
    """One replica holds authors a0 to a2, the other a0, a1 and a3."""
    log = event_log(spark, sf_dir)
    return OpLog(log.df.where("author != 'a3'")), OpLog(log.df.where("author != 'a2'"))


@query(f"WITH {LOG} SELECT author, count(*) AS n, max(ms) AS ms FROM log WHERE author = 'a2' GROUP BY author")
def sync_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _replicas(spark, sf_dir)
    from ..functions.clock import HybridClock

    return sync.missing(left, sync.offer(right, HybridClock("b"))).groupBy("author").agg(F.count("*").alias("n"), F.max("physical_ms").alias("ms"))


@query(f"WITH {LOG} SELECT author, max(ms) AS physical_ms FROM log WHERE author = 'a3' GROUP BY author")
def sync_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _replicas(spark, sf_dir)
    from ..functions.clock import HybridClock

    wanted = sync.needed(left, sync.offer(right, HybridClock("b")))
    return right.df.join(wanted, "hash", "left_semi").select("author", "physical_ms")


@query(f"WITH {_replayed()} SELECT props.id AS node_id, key, v FROM props JOIN state USING (id) WHERE live")
def checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph after compaction is the graph before it."""
    log = event_log(spark, sf_dir)
    small = compact.compact(log, log.materialize(), "a0", 1 << 42)
    return _flat(small.materialize().nodes)


@query("SELECT k AS peers, CAST(least(k, CASE WHEN k <= 2 THEN k ELSE ceil(ln(k) + 1) END) AS INTEGER) AS targets FROM (SELECT CAST(unnest([1, 2, 3, 10, 50]) AS INTEGER) AS k)")
def gossip_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for k in (1, 2, 3, 10, 50):
        registry = sync.PeerRegistry("me")
        for i in range(k):
            registry.register(f"p{i}")
        rows.append((k, len(registry.select_targets(7))))
    return spark.createDataFrame(rows, "peers int, targets int")


# -- observations -----------------------------------------------------------

_OBS = "obs AS (SELECT event_type AS source, epoch_us(ts) // 1000 AS timestamp_ms, arg_max(value, event_id) AS value, arg_max(CAST(user_id AS VARCHAR), event_id) AS user FROM events GROUP BY event_type, epoch_us(ts) // 1000)"


@query(f"WITH {_OBS} SELECT timestamp_ms, value, \"user\" FROM obs WHERE source = 'click' AND timestamp_ms >= {_CUT}")
def obs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).query("click", _cut(spark, sf_dir)).select("timestamp_ms", "value", F.col("metadata")["user"].alias("user"))


@query(f"WITH {_OBS} SELECT source, max(timestamp_ms) AS timestamp_ms, arg_max(value, timestamp_ms) AS value FROM obs GROUP BY source")
def obs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).query_latest().select("source", "timestamp_ms", "value")


@query("SELECT DISTINCT event_type AS source FROM events")
def obs_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).sources()


@query(f"WITH {_OBS} SELECT source, count(*) AS n FROM obs WHERE timestamp_ms >= {_CUT} GROUP BY source")
def obs_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(observations(spark, sf_dir).truncate(_cut(spark, sf_dir))[0].df, "source")


@query(f"WITH {_OBS} SELECT count(*) AS n FROM obs")
def obs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(observations(spark, sf_dir).df)


# -- schemas (no tables, so no SQL) -----------------------------------------


@query()
def ontology_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAR.facts_table(spark)


@query("SELECT * FROM (VALUES ('same', 'identical'), ('more', 'superset'), ('less', 'subset'), ('other', 'divergent')) t(versus, verdict)")
def ontology_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = STAR.extended({"node_types": {"warehouse": {"parent_type": "place"}}})
    other = STAR.extended({"node_types": {"depot": {}}})
    rows = [("same", STAR.compatibility(Ontology(STAR.to_json()))), ("more", more.compatibility(STAR)), ("less", STAR.compatibility(more)), ("other", more.compatibility(other))]
    return spark.createDataFrame(rows, "versus string, verdict string")
