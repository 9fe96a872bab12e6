"""The driver's tables as graphs and logs: a star graph, an operation log, observations and a cyclic graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import ENTRY_NAMES, layout
from ..functions.values import PROPERTIES, of_column
from ..operators.graph import Graph
from ..operators.obslog import ObservationLog
from ..operators.ontology import Ontology
from ..operators.oplog import OpLog, hash_of, with_hash

STAR = Ontology(
    {
        "node_types": {
            "place": {},
            "region": {"parent_type": "place"},
            "nation": {"parent_type": "place"},
            "party": {"properties": {"acctbal": "float"}},
            "customer": {"parent_type": "party", "properties": {"mktsegment": "string"}},
            "supplier": {"parent_type": "party"},
            "part": {"properties": {"brand": "string", "type": "string", "size": "int", "retailprice": "float"}},
            "order": {"properties": {"totalprice": "float", "priority": "string"}, "subtypes": {"F": {}, "O": {}, "P": {}}},
        },
        "edge_types": {
            "IN_REGION": {"source_types": ["nation"], "target_types": ["region"]},
            "IN_NATION": {"source_types": ["party"], "target_types": ["nation"]},
            "PLACED_BY": {"source_types": ["order"], "target_types": ["customer"]},
            "CONTAINS": {"source_types": ["order"], "target_types": ["part"]},
            "SUPPLIES": {"source_types": ["supplier"], "target_types": ["part"]},
        },
    }
)
USERS = Ontology({"node_types": {"user": {"properties": {"value": {"value_type": "float", "required": True}, "k": "int"}}}, "edge_types": {"NEXT": {"source_types": ["user"], "target_types": ["user"]}}})


VIP = USERS.extended({"node_types": {"vip": {"properties": {"value": {"value_type": "float"}, "k": "int"}}}})


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def _props(**values: tuple[str, str]) -> Column:
    if not values:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<kind:string,lit:string>>")).cast(PROPERTIES)
    return F.create_map(*(x for name, (column, kind) in values.items() for x in (F.lit(name), of_column(F.col(column), kind)))).cast(PROPERTIES)


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders, and how they hang together."""

    def nodes(table: str, kind: str, prefix: str, key: str, label: Column, props: Column, subtype: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("string")
        return _read(spark, sf_dir, table).select(_key(prefix, key).alias("node_id"), F.lit(kind).alias("node_type"), (none if subtype is None else subtype).alias("subtype"), label.alias("label"), props.alias("properties"), F.lit(True).alias("live"))

    all_nodes = [
        nodes("region", "region", "r", "r_regionkey", F.col("r_name"), _props()),
        nodes("nation", "nation", "n", "n_nationkey", F.col("n_name"), _props()),
        nodes("customer", "customer", "c", "c_custkey", F.col("c_name"), _props(acctbal=("c_acctbal", "float"), mktsegment=("c_mktsegment", "string"))),
        nodes("supplier", "supplier", "s", "s_suppkey", F.col("s_name"), _props(acctbal=("s_acctbal", "float"))),
        nodes("part", "part", "p", "p_partkey", F.col("p_name"), _props(brand=("p_brand", "string"), type=("p_type", "string"), size=("p_size", "int"), retailprice=("p_retailprice", "float"))),
        nodes("orders", "order", "o", "o_orderkey", _key("o", "o_orderkey"), _props(totalprice=("o_totalprice", "float"), priority=("o_orderpriority", "string")), F.col("o_orderstatus")),
    ]

    def edges(df: DataFrame, kind: str, id_: Column, source: Column, target: Column, props: Column | None = None) -> DataFrame:
        return df.select(id_.alias("edge_id"), F.lit(kind).alias("edge_type"), source.alias("source_id"), target.alias("target_id"), (_props() if props is None else props).alias("properties"), F.lit(True).alias("live"))

    lines = _read(spark, sf_dir, "lineitem")
    contains = lines.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("lines"))
    supplies = lines.select("l_suppkey", "l_partkey").distinct()
    all_edges = [
        edges(_read(spark, sf_dir, "nation"), "IN_REGION", _key("nr", "n_nationkey"), _key("n", "n_nationkey"), _key("r", "n_regionkey")),
        edges(_read(spark, sf_dir, "customer"), "IN_NATION", _key("cn", "c_custkey"), _key("c", "c_custkey"), _key("n", "c_nationkey")),
        edges(_read(spark, sf_dir, "supplier"), "IN_NATION", _key("sn", "s_suppkey"), _key("s", "s_suppkey"), _key("n", "s_nationkey")),
        edges(_read(spark, sf_dir, "orders"), "PLACED_BY", _key("oc", "o_orderkey"), _key("o", "o_orderkey"), _key("c", "o_custkey")),
        edges(contains, "CONTAINS", F.concat(F.lit("ol:"), "l_orderkey", F.lit(":"), "l_partkey"), _key("o", "l_orderkey"), _key("p", "l_partkey"), _props(qty=("qty", "float"), lines=("lines", "int"))),
        edges(supplies, "SUPPLIES", F.concat(F.lit("sp:"), "l_suppkey", F.lit(":"), "l_partkey"), _key("s", "l_suppkey"), _key("p", "l_partkey")),
    ]
    return Graph(reduce(DataFrame.unionByName, all_nodes), reduce(DataFrame.unionByName, all_edges), STAR)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    df = _read(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return df.withColumn("physical_ms", ms).withColumn("logical", (F.row_number().over(W.partitionBy("physical_ms").orderBy("event_id")) - 1).cast("int")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _operations(spark: SparkSession, sf_dir: str, vip: bool = False) -> DataFrame:
    """Events as operations of four authors on users, without names and parents; with ``vip``, every tenth user is of that type."""
    df = _events(spark, sf_dir).withColumn("author", F.concat(F.lit("a"), (F.col("event_id") % 4).cast("string")))
    user = _key("u", "user_id")
    signup, error = F.col("event_type") == "signup", F.col("event_type") == "error"
    update = ~signup & ~error
    kind = F.when(F.col("user_id") % 10 == 0, "vip").otherwise("user") if vip else F.lit("user")
    return df.select(
        "event_id",
        "author",
        F.col("author").alias("clock_id"),
        "physical_ms",
        "logical",
        F.when(signup, "add_node").when(error, "remove_node").otherwise("update_property").alias("op"),
        F.when(~update, user).alias("node_id"),
        F.when(signup, kind).alias("node_type"),
        F.when(signup, user).alias("label"),
        F.when(signup, _props(value=("value", "float"), k=("k", "int"))).alias("properties"),
        F.when(update, user).alias("entity_id"),
        F.when(update, F.col("event_type")).alias("key"),
        F.when(update, of_column(F.col("value"), "float")).alias("value"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> OpLog:
    """The events as a log; each entry's parent is its author's one before.

    Entry names are digests of event ids: a chain of content digests could only be made one after another.
    """
    from pyspark.sql import Window as W

    rows = _operations(spark, sf_dir).withColumn("hash", F.sha2(F.col("event_id").cast("string"), 256))
    before = F.lag("hash").over(W.partitionBy("author").orderBy("physical_ms", "logical"))
    genesis_hash = F.sha2(F.lit("genesis"), 256)
    rows = rows.withColumn("next", F.array(F.coalesce(before, genesis_hash)))
    genesis = spark.range(1).select(
        genesis_hash.alias("hash"), F.lit("a0").alias("author"), F.lit("a0").alias("clock_id"), F.lit(0).cast("long").alias("physical_ms"), F.lit(0).alias("logical"), F.lit("define_ontology").alias("op"), F.lit(USERS.to_json()).alias("schema_json")
    )
    return OpLog(with_hash(rows, named=True).unionByName(with_hash(genesis, named=True)))


DAY = 86_400_000


def content_log(spark: SparkSession, sf_dir: str, vip: bool = False) -> OpLog:
    """The events as a log whose entries are named by their content.

    An author's first entry of a day has that of the day before as its parent, all others of the day
    have that first one; so the log is as deep as it has days, and all but the first entries are
    hashed in parallel.  First entries are as many as authors times days.
    """
    rows = _operations(spark, sf_dir, vip).drop("event_id").withColumn("day", F.floor(F.col("physical_ms") / DAY))
    heads = rows.groupBy("author", "day").agg(F.min(F.struct("physical_ms", "logical")).alias("at"))
    heads = F.broadcast(heads.select("author", "day", "at.physical_ms", "at.logical"))
    on = ["author", "day", "physical_ms", "logical"]
    schema = VIP if vip else USERS
    genesis = dict.fromkeys(ENTRY_NAMES) | {"author": "a0", "clock_id": "a0", "physical_ms": 0, "logical": 0, "next": [], "op": "define_ontology", "schema_json": schema.to_json()}
    genesis["hash"] = hash_of(genesis)
    first, last, names = [genesis], {}, []
    for r in sorted((r.asDict(recursive=True) for r in rows.join(heads, on, "left_semi").collect()), key=lambda r: (r["author"], r["day"])):
        entry = dict.fromkeys(ENTRY_NAMES) | {k: v for k, v in r.items() if k != "day"} | {"next": [last.get(r["author"], genesis["hash"])]}
        entry["hash"] = last[r["author"]] = hash_of(entry)
        first.append(entry)
        names.append((r["author"], r["day"], entry["hash"]))
    parents = F.broadcast(spark.createDataFrame(names, "author string, day long, parent string"))
    others = rows.join(heads, on, "left_anti").join(parents, ["author", "day"]).withColumn("next", F.array("parent"))
    return OpLog(with_hash(others).unionByName(spark.createDataFrame([tuple(e[c] for c in layout().names) for e in first], layout()).select(*ENTRY_NAMES)))


def observations(spark: SparkSession, sf_dir: str) -> ObservationLog:
    df = _events(spark, sf_dir)
    return ObservationLog(df.select(F.col("event_type").alias("source"), F.col("physical_ms").alias("timestamp_ms"), "value", F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.col("k").cast("string")).alias("metadata"), F.col("event_id").alias("seq")))


def user_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """An edge from each event's user to the next event's user: dense and cyclic."""
    from pyspark.sql import Window as W

    df = _read(spark, sf_dir, "events").select("event_id", "ts", _key("u", "user_id").alias("u"))
    # consecutive pairs over one total order; days are ordered in parallel, and joined at their ends
    day = df.withColumn("day", F.to_date("ts"))
    w = W.partitionBy("day").orderBy("ts", "event_id")
    inside = day.withColumn("target_id", F.lead("u").over(w))
    heads = day.groupBy("day").agg(F.min_by("u", F.struct("ts", "event_id")).alias("u"))
    heads = heads.withColumn("before", F.lag("day").over(W.orderBy("day"))).select(F.col("before").alias("day"), F.col("u").alias("head"))
    rows = inside.join(heads, "day", "left").select("event_id", F.col("u").alias("source_id"), F.coalesce("target_id", "head").alias("target_id")).where("target_id is not null")
    none = F.lit(None).cast("string")
    nodes = df.select(F.col("u").alias("node_id")).distinct().select("node_id", F.lit("user").alias("node_type"), none.alias("subtype"), F.col("node_id").alias("label"), _props().alias("properties"), F.lit(True).alias("live"))
    edges = rows.select(_key("e", "event_id").alias("edge_id"), F.lit("NEXT").alias("edge_type"), "source_id", "target_id", _props().alias("properties"), F.lit(True).alias("live"))
    return Graph(nodes, edges, USERS)
