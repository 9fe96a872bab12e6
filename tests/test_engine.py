"""Rules of the log, the graph and the schema on small hand-made logs."""

import random

import pytest


from ledgraph.functions.clock import HybridClock
from ledgraph.functions.values import decode, encode, encode_all
from ledgraph.functions.schema import layout
from ledgraph.operators import signing, sync
from ledgraph.operators.compact import IntervalPolicy, ThresholdPolicy, compact

from ledgraph.operators.ontology import Ontology, OntologyError
from ledgraph.operators.oplog import OpLog, with_hash
from ledgraph.operators.query import Query
from ledgraph.sources.buffer import OperationBuffer
from ledgraph.sources.store import GraphStore, ValidationError

SCHEMA = {
    "node_types": {
        "thing": {"properties": {"name": {"value_type": "string"}}},
        "server": {"parent_type": "thing", "properties": {"port": {"value_type": "int", "constraints": {"min": 1, "max": 65535}}, "status": {"value_type": "string", "constraints": {"enum": ["up", "down"]}}}},
        "box": {"subtypes": {"small": {"properties": {"w": {"value_type": "int", "required": True}}}, "big": {}}},
    },
    "edge_types": {"LINKS": {"source_types": ["thing"], "target_types": ["thing"]}},
}


def entries(spark, rows):
    """A log from (op, clock, fields); the clock is (physical, logical, id)."""
    full = [("define_ontology", (0, 0, "z"), {"schema_json": Ontology(SCHEMA).to_json()}), *rows]
    out = []
    for op, (physical, logical, id_), fields in full:
        row = dict.fromkeys(layout().names) | {"op": op, "physical_ms": physical, "logical": logical, "clock_id": id_, "author": id_, "next": []} | fields
        if "properties" in fields:
            row["properties"] = encode_all(fields["properties"])
        if "value" in fields:
            row["value"] = encode(fields["value"])
        out.append(tuple(row[c] for c in layout().names))
    return OpLog(with_hash(spark.createDataFrame(out, layout())))


def node(at, id_="n", kind="thing", label="L", **props):
    return ("add_node", at, {"node_id": id_, "node_type": kind, "label": label, "properties": props})


def state(log):
    return {r["node_id"]: (r["node_type"], r["label"], r["live"], {k: decode(v) for k, v in r["properties"].items()}) for r in log.materialize().nodes.collect()}


def test_values_keep_kinds():
    for v in (None, True, 3, 3.0, "x", [1, 2.0, "a"], {"k": [None]}):
        assert decode(encode(v)) == v and type(decode(encode(v))) is type(v)
    with pytest.raises(TypeError):
        encode(object())


def test_clock_rules():
    c = HybridClock("a", 10, 0)
    assert c.tick(5).as_tuple() == (10, 1) and c.tick(11).as_tuple() == (11, 0)
    assert c.merge(HybridClock("b", 10, 4), 3).as_tuple() == (10, 5)
    assert HybridClock("a", 1, 1).wins_over(HybridClock("b", 1, 1))


def test_replay_rules(spark):
    log = entries(
        spark,
        [
            ("update_property", (1, 0, "a"), {"entity_id": "n", "key": "x", "value": 1}),  # before the node exists
            node((2, 0, "a"), name="first"),
            ("update_property", (3, 0, "b"), {"entity_id": "n", "key": "name", "value": "b"}),
            ("update_property", (3, 0, "a"), {"entity_id": "n", "key": "name", "value": "a"}),  # lower id wins
            ("remove_node", (4, 0, "a"), {"node_id": "n"}),
            node((5, 0, "a"), kind="server", label="again"),  # the type stays
            node((6, 0, "a"), "m"),
            ("remove_node", (7, 0, "a"), {"node_id": "m"}),
            ("remove_node", (8, 0, "a"), {"node_id": "ghost"}),
        ],
    )
    assert state(log) == {"n": ("thing", "again", True, {"name": "a"}), "m": ("thing", "L", False, {})}


def test_quarantine_and_pending_edges(spark):
    log = entries(
        spark,
        [
            ("add_edge", (1, 0, "a"), {"edge_id": "e", "edge_type": "LINKS", "source_id": "p", "target_id": "q", "properties": {}}),
            ("add_edge", (1, 1, "a"), {"edge_id": "f", "edge_type": "LINKS", "source_id": "p", "target_id": "gone", "properties": {}}),
            node((2, 0, "a"), "p"), node((3, 0, "a"), "q", "server", port=80),
            node((4, 0, "a"), "bad", "server", port=0), node((5, 0, "a"), "odd", "nope"), node((6, 0, "a"), "float", "server", port=1.0),
            ("update_property", (7, 0, "a"), {"entity_id": "q", "key": "status", "value": "sideways"}),
            node((8, 0, "a"), "sub", "box"),
            ("add_node", (9, 0, "a"), {"node_id": "s", "node_type": "box", "label": "s", "subtype": "small", "properties": {}}),
        ],
    )
    m = log.materialize()
    assert {r["edge_id"] for r in m.edges.collect()} == {"e"}
    reasons = sorted(r["reason"] for r in m.quarantine.collect())
    assert reasons == sorted(["target node not found", "port violates min", "unknown node type: nope", "port is not of type int", "status is not one of the allowed values", "box requires a subtype", "missing required property w"])


def fold(rows):
    """The rules one after another, as a model."""
    nodes = {}
    for op, at, f in sorted(rows, key=lambda r: (r[1][0], r[1][1])):
        if op == "add_node":
            n = nodes.setdefault(f["node_id"], {"type": f["node_type"], "props": {}})
            n.update(live=True, label=f["label"])
            n["props"] |= f["properties"]
        elif op == "remove_node" and f["node_id"] in nodes:
            nodes[f["node_id"]]["live"] = False
        elif op == "update_property" and f["entity_id"] in nodes:
            nodes[f["entity_id"]]["props"][f["key"]] = f["value"]
    return {k: (n["type"], n["label"], n["live"], n["props"]) for k, n in nodes.items()}


def test_replay_equals_a_sequential_fold_in_any_row_order(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        at, id_ = (i + 1, 0, "a"), f"n{rng.randrange(8)}"
        kind = rng.choice(["add_node", "remove_node", "update_property", "update_property"])
        rows.append({"add_node": ("add_node", at, {"node_id": id_, "node_type": "thing", "label": f"l{i}", "properties": {"x": i}}), "remove_node": ("remove_node", at, {"node_id": id_}), "update_property": ("update_property", at, {"entity_id": id_, "key": rng.choice("xy"), "value": i})}[kind])
    want = fold(rows)
    log = entries(spark, rows)
    assert state(log) == want
    rng.shuffle(rows)
    assert state(entries(spark, rows)) == want
    # compaction keeps the live graph
    small = compact(log, log.materialize(), "a", 1000)
    assert {k: v for k, v in state(small).items() if v[2]} == {k: v for k, v in want.items() if v[2]}
    # the causal order of a chain is the clocks' order
    assert log.causal_positions().count() == 121


def test_ontology_evolution():
    o = Ontology(SCHEMA)
    assert o.family("thing") == ["server", "thing"] and o.is_a("server", "thing")
    more = o.extended({"node_types": {"vm": {"parent_type": "server"}}, "edge_type_updates": {"LINKS": {"add_target_types": ["box"]}}})
    assert more.compatibility(o) == "superset" and o.compatibility(more) == "subset" and o.compatibility(Ontology(SCHEMA)) == "identical"
    for bad in ({}, {"node_types": {"thing": {}}}, {"node_type_updates": {"nope": {}}}, {"what": {"x": 1}}):
        with pytest.raises(OntologyError):
            o.extended(bad)
    with pytest.raises(OntologyError):
        Ontology({"node_types": {"a": {"properties": {"p": {"value_type": "int", "constraints": {"least": 1}}}}}})


@pytest.fixture(scope="module")
def graph(spark):
    ids = "abcde"
    rows = [node((i + 1, 0, "a"), c, "server" if c in "ab" else "thing", port=i + 1) for i, c in enumerate(ids)]
    arcs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b")]
    rows += [("add_edge", (50 + i, 0, "a"), {"edge_id": f"e{i}", "edge_type": "LINKS", "source_id": s, "target_id": t, "properties": {}}) for i, (s, t) in enumerate(arcs)]
    return entries(spark, rows).graph()


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_graph_scans_and_walks(graph):
    assert ids(graph.query_nodes_by_type("thing")) == list("abcde") and ids(graph.query_nodes_by_type("nope")) == []
    assert ids(graph.query_nodes_by_property("port", 2)) == ["b"] and ids(graph.query_nodes_by_property("port", 2.0)) == []
    assert ids(graph.neighbors("a")) == ["b", "b"]
    assert {r["node_id"]: r["depth"] for r in graph.bfs("a").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert graph.shortest_path("a", "d") == ["a", "b", "c", "d"] and graph.shortest_path("d", "a") is None and graph.shortest_path("e", "e") == ["e"]
    assert ids(graph.impact_analysis("d", 1).select("node_id")) == ["c", "d"]
    assert graph.has_cycle() and graph.topological_sort() is None
    near, touched = graph.subgraph("d", 1)
    assert ids(near.select("node_id")) == ["c", "d"] and ids(touched.select("edge_id")) == ["e3"]
    assert sorted(map(tuple, graph.pattern_match(["server", "server"]).collect())) == [("a", "b"), ("a", "b")]


def test_query_and_views(graph):
    q = Query(graph)
    assert q.nodes("server").where(port=1.0).collect_ids() == ["a"]
    assert sorted(q.nodes().where_fn(lambda n: n["properties"]["port"] > 3).collect_ids()) == ["d", "e"]
    assert q.nodes("server").follow("LINKS").count() == 2
    assert sorted(q.nodes().where(port=3).follow(direction="both").collect_ids()) == ["a", "b", "d"]
    assert q.nodes().where(missing=None).count() == 5 and q.nodes().limit(2).collect_ids() == ["a", "b"]
    with pytest.raises(RuntimeError):
        q.where(x=1)
    view = graph.view(node_types=["server"])
    assert ids(view.all_edges().select("edge_id")) == ["e0", "e4"] and ids(view.query_nodes_by_type("thing").select("node_id")) == ["a", "b"]


def test_store_round_trip(spark, tmp_path):
    store = GraphStore(spark, "one", SCHEMA, str(tmp_path / "log"))
    seen = []
    store.subscribe(lambda e: seen.append(e["op"]))
    store.add_node("a", "server", "A", {"port": 80})
    store.add_node("b", "thing", "B")
    store.add_edge("e", "LINKS", "a", "b")
    store.update_property("a", "port", 81)
    for bad in (lambda: store.add_node("x", "server", "X", {"port": 0}), lambda: store.add_edge("y", "LINKS", "a", "ghost"), lambda: store.update_property("a", "port", "p")):
        with pytest.raises(ValidationError):
            bad()
    store.flush()
    assert seen == ["add_node", "add_node", "add_edge", "update_property"]
    again = GraphStore.open(spark, str(tmp_path / "log"))
    assert Query(again.graph()).nodes("server").first()["properties"] == {"port": 81}
    assert again.log.verify_integrity()
    other = GraphStore.from_snapshot(spark, "two", store.snapshot())
    other.remove_node("b")
    assert store.merge_sync_payload(other.receive_sync_offer(store.generate_sync_offer())) == 1
    assert ids(store.graph().all_nodes().select("node_id")) == ["a"]
    assert store.merge_sync_payload(other.snapshot()) == 0
    store.compact(safe=False)
    assert ids(store.graph().all_nodes().select("node_id")) == ["a"] and store.log.count() == 1


def test_buffer_drains_until_the_first_failure(spark, tmp_path):
    store = GraphStore(spark, "one", SCHEMA)
    buffer = OperationBuffer(str(tmp_path / "ops.jsonl"))
    buffer.add_node("a", "thing", "A")
    buffer.add_node("b", "nope", "B")
    buffer.add_node("c", "thing", "C")
    assert len(buffer) == 3 and buffer.read(spark).count() == 3
    with pytest.raises(ValidationError):
        buffer.drain(store)
    assert [r["node_id"] for r in buffer.read_all()] == ["b", "c"]


def test_signatures(spark):
    key = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert signing.public_key(key).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    made = signing.sign(key, b"")
    assert made.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert signing.verify(signing.public_key(key), b"", made) and not signing.verify(signing.public_key(key), b"x", made)


def test_policies_and_peers(spark):
    assert not ThresholdPolicy(2).should_compact(2) and ThresholdPolicy(2).should_compact(3)
    p = IntervalPolicy(1000)
    assert p.should_compact(0) and not p.should_compact(0)
    b = sync.BloomFilter.empty(spark, 100)
    b.insert("x")
    assert b.contains("x") and not b.contains("nothing like it")


def test_tail_stream(spark, tmp_path):
    from ledgraph.streaming.tail import TailSubscription, subscribe

    store = GraphStore(spark, "one", SCHEMA, str(tmp_path / "log"))
    for c in "abc":
        store.add_node(c, "thing", c)
    store.flush()
    got = []
    q = subscribe(spark, str(tmp_path / "log"), lambda df, _: got.extend(r["op"] for r in df.collect()), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination()
    assert sorted(got) == ["add_node"] * 3 + ["define_ontology"]
    tail = TailSubscription(lambda: store.log)
    batches = [tail.next_batch(3), tail.next_batch(3), tail.next_batch(3)]
    assert [len(b) for b in batches] == [3, 1, 0]
    store.add_node("d", "thing", "d")
    assert [e["node_id"] for e in tail.next_batch()] == ["d"]


def test_driver_hash_and_validators_are_those_of_the_columns(spark):
    from pyspark.sql import functions as F

    from ledgraph.operators.oplog import entry_hash, hash_of

    texts = ["plain", 'q"b\\s/', "tab\tnl\n\x01\x1f\x7f", "é日\U0001f600 ", ""]
    rows = [dict.fromkeys(layout().names) | {"op": "add_node", "node_id": t, "label": t, "properties": encode_all({"z": t, "a": 1, "é": [1, None], "m": {"k": t}}), "physical_ms": 5, "logical": 1, "clock_id": "c", "author": "x", "next": ["b" * 64, "a" * 64]} for t in texts]
    df = spark.createDataFrame([tuple(r[c] for c in layout().names) for r in rows], layout())
    assert [r["h"] for r in df.select(entry_hash().alias("h")).collect()] == [hash_of(r) for r in rows]
    o = Ontology(SCHEMA)
    cases = [("server", None, p) for p in ({}, {"port": 0}, {"port": 70000}, {"port": 1.5}, {"port": None, "status": "up"}, {"status": "sideways"}, {"name": 3})] + [("box", None, {}), ("box", "small", {}), ("box", "small", {"w": 1}), ("box", "other", {}), ("nope", None, {})]
    for kind, sub, props in cases:
        e = encode_all(props)
        column = spark.createDataFrame([(e,)], "p map<string,struct<kind:string,lit:string>>").select(o.node_error(F.lit(kind), F.lit(sub).cast("string"), F.col("p"))).first()[0]
        assert column == o.judge_node(kind, sub, e), (kind, sub, props)
    assert o.judge_edge("LINKS", "server", "thing", {}) is None and o.judge_edge("LINKS", "box", "thing", {}) == "LINKS does not allow source type box"
    assert o.judge_update("server", None, None, "port", encode(0)) == "port violates min" and o.judge_update("server", None, None, "name", encode(1)) == "name is not of type string"


def test_writes_know_the_graph_without_replaying_it(spark, tmp_path):
    store = GraphStore(spark, "one", SCHEMA, str(tmp_path / "log"), codec="zstd")
    store.add_node("a", "server", "A")
    store.flush()
    store.add_node("a", "thing", "still a server")
    with pytest.raises(ValidationError):
        store.update_property("a", "port", 0)
    store.remove_node("a")
    with pytest.raises(ValidationError):
        store.add_edge("e", "LINKS", "a", "a")
    assert store.pending_flush_count() == 2
    store.set_flush_mode("immediate")
    store.add_node("b", "server", "B", {"port": 1})
    assert store.pending_flush_count() == 0 and len(store) == 5
    with pytest.raises(ValueError):
        store.set_flush_mode("sometimes")
    assert store.reclaim_disk() > 0 and len(store) == 5 and store.verify_integrity()
    h = store.add_node("c", "server", "C")
    assert store.get(h)["node_id"] == "c" and store.get("0" * 64) is None and store.memory_usage() > 0
    with pytest.raises(ValueError):
        store.get("no hash")
    assert store.node_type_names() == ["box", "server", "thing"] and store.edge_type_names() == ["LINKS"] and store.clock_time() == store.clock.as_tuple()
    assert ThresholdPolicy(3).check(store) is not None and len(store) == 1 and ThresholdPolicy(3, reclaim_disk=True).check(store) is None


def test_bulk_writes_are_numbered_in_order(spark, tmp_path):
    store = GraphStore(spark, "one", SCHEMA, str(tmp_path / "log"))
    ops = spark.range(500).selectExpr("id AS seq", "'add_node' AS op", "concat('n', id) AS node_id", "'thing' AS node_type", "'x' AS label").repartition(7)
    assert store.append_ops(ops) == 500
    rows = store.log.df.where("op = 'add_node'").orderBy("logical").collect()
    assert [r["node_id"] for r in rows] == [f"n{i}" for i in range(500)] and len({r["logical"] for r in rows}) == 500
    assert store.verify_integrity() and store.append_ops(ops.limit(0)) == 0


def test_merge_gates(spark):
    store = GraphStore(spark, "one", SCHEMA)
    store.add_node("mine", "thing", "M")
    other = GraphStore.from_snapshot(spark, "two", store.snapshot())
    other.add_node("theirs", "thing", "T")
    other.compact(safe=False)
    other.add_node("later", "thing", "L")
    # a foreign checkpoint is refused, and what builds on it alone can't come
    boxed = other.snapshot().where("op = 'checkpoint'")
    assert store.merge_sync_payload(boxed) == 0 and store.log.df.where("op = 'checkpoint'").count() == 0
    fresh = GraphStore(spark, "three", SCHEMA)
    assert fresh.merge_sync_payload(boxed) == 1
    # far in the future
    far = entries(spark, [node((9_000_000_000_000, 0, "z"), "far")]).df.where("op = 'add_node'")
    before = store.clock.physical_ms
    assert store.merge_sync_payload(far) == 0 and store.clock.physical_ms < before + 1_000_000
    # in any order, twice over; a changed entry is an error
    third = GraphStore.from_snapshot(spark, "four", store.snapshot())
    for c in "xyz":
        third.add_node(c, "thing", c)
    batch = third.snapshot().orderBy("hash")
    assert store.merge_sync_payload(batch) == 3 and store.merge_sync_payload(batch) == 0
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        fresh.merge_sync_payload(third.snapshot().withColumn("label", F.lit("forged")))
    with pytest.raises(ValueError):
        sync.admitted(fresh.log, batch, max_entries=2)


def test_snapshot_clock_and_revalidation(spark):
    late = entries(spark, [node((9_000_000_000_000, 7, "z"), "n", name="old")])
    store = GraphStore.from_snapshot(spark, "two", late.df)
    assert store.clock.as_tuple() >= (9_000_000_000_000, 7)
    store.update_property("n", "name", "new")
    assert Query(store.graph()).nodes("thing").first()["properties"] == {"name": "new"}
    one = GraphStore(spark, "one", SCHEMA)
    batch = spark.createDataFrame([("add_node", "v", "vm", "V")], "op string, node_id string, node_type string, label string")
    one.append_ops(batch)
    assert one.get_quarantined().count() == 1 and one.revalidate() == 0
    one.extend_ontology({"node_types": {"vm": {}}})
    assert one.revalidate() == 1 and one.get_quarantined().count() == 0 and ids(one.graph().all_nodes().select("node_id")) == ["v"]


def test_reopening_needs_every_parent(spark, tmp_path):
    store = GraphStore(spark, "one", SCHEMA)
    for c in "abc":
        store.add_node(c, "thing", c)
    store.snapshot().where("label != 'b' or label is null").write.parquet(str(tmp_path / "torn"))
    with pytest.raises(ValueError):
        GraphStore.open(spark, str(tmp_path / "torn"))


def test_a_tail_of_many_heads_gathers_nothing_on_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    from ledgraph.streaming.tail import TailSubscription

    store = GraphStore(spark, "one", SCHEMA, str(tmp_path / "log"))
    store.append_ops(spark.range(300).selectExpr("id AS seq", "'add_node' AS op", "concat('n', id) AS node_id", "'thing' AS node_type", "'x' AS label"))
    tail, most, collect = TailSubscription(lambda: store.log), [0], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (rows := collect(self), most.append(len(rows)))[0])
    frames = [tail.next_frame(200), tail.next_frame(200)]
    later = tail.next_frame(200)
    assert [f.count() for f in [*frames, later]] == [200, 101, 0] and max(most) < 100
    monkeypatch.undo()
    assert [r["logical"] for r in frames[0].orderBy("logical").collect()][1:] == sorted(r["logical"] for r in frames[0].collect())[1:]
    assert len({r["hash"] for f in frames for r in f.collect()}) == 301 and len(tail.current_cursor()) == 300


def test_a_bulk_append_gathers_no_heads(spark, monkeypatch):
    from pyspark.sql import DataFrame

    store, most, collect = GraphStore(spark, "one", SCHEMA), [0], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (rows := collect(self), most.append(len(rows)))[0])
    assert store.append_ops(spark.range(300).selectExpr("id AS seq", "'add_node' AS op", "concat('n', id) AS node_id", "'thing' AS node_type", "'x' AS label")) == 300
    assert max(most) < 100
    monkeypatch.undo()
    heads = sorted(r["hash"] for r in store.log.df.where("op = 'add_node'").collect())
    store.register_subscriber_cursor("all", heads)
    store.register_subscriber_cursor("few", heads[:3])
    assert [r for r in store.verify_compaction_safe()[1] if "subscriber" in r] == ["subscriber few is behind"]
    # the next write builds on them all
    assert store.get(store.add_node("m", "thing", "M"))["next"] == heads


def test_causal_order_takes_leaves_over_the_cluster(spark, monkeypatch):
    from ledgraph.operators import oplog

    rng = random.Random(3)
    names, rows = [f"{i:03d}" for i in range(160)], []
    for i, h in enumerate(names):
        some = rng.sample(names[: min(i, 25)], k=min(i, rng.randrange(4)))
        rows.append(tuple((dict.fromkeys(layout().names) | {"hash": h, "op": "add_node", "physical_ms": rng.randrange(3), "logical": 0, "next": some + some[:1] + ["absent"]})[c] for c in layout().names))
    key, left = {r[0]: (r[3], r[4], r[0]) for r in rows}, {r[0]: {p for p in r[5] if p != "absent"} for r in rows}
    queue = sorted((h for h in names if not left[h]), key=key.get)
    for h in queue:
        queue += sorted((c for c in names if h in left[c] and len(left[c]) == 1), key=key.get)
        for c in names:
            left[c].discard(h)
    got = OpLog(spark.createDataFrame(rows, layout())).causal_positions().orderBy("pos").collect()
    assert [r["hash"] for r in got] == queue and [r["pos"] for r in got] == list(range(160))
    # only the 25 entries that others build on meet in one group
    pairs = [(3, -1), (0, -1), (1, -1), (2, -1), (3, 0), (2, 1), (1, 0)]
    assert oplog._in_order()(__import__("pandas").DataFrame(pairs, columns=["id", "parent_id"])).to_dict("list") == {"id": [0, 1, 3, 2], "place": [0, 1, 2, 3]}
    sizes = []
    real = oplog.numbered
    monkeypatch.setattr(oplog, "numbered", lambda *a: (out := real(*a), sizes.append((a[2], out[1])))[0])
    OpLog(spark.createDataFrame(rows, layout())).causal_positions()
    assert dict(sizes)["pos"] == 160 and dict(sizes)["id"] <= 25


def test_views_read_no_edges_that_the_schema_keeps_out(spark):
    from ledgraph.sources.fixtures import star_graph

    edges = star_graph(spark, "/root/testdata/sf0.001").view(node_types=["customer", "order"]).all_edges()
    assert {f.rsplit("/", 1)[1] for f in edges.inputFiles()} == {"orders.parquet", "customer.parquet"} and edges.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_checkpoints_are_taken_apart_once(spark):
    log = entries(spark, [node((2, 0, "a"), "b", name="x"), node((1, 0, "a"), "a", "server", port=1), ("add_edge", (3, 0, "a"), {"edge_id": "e", "edge_type": "LINKS", "source_id": "a", "target_id": "b", "properties": {}})])
    small = compact(log, log.materialize(), "a", 1000)
    boxed = small.df.first()["ckpt_ops"]
    assert [(x["op"], x["node_id"] or x["edge_id"] or x["entity_id"], x["key"], x["properties"]) for x in boxed] == [("define_ontology", None, None, None), ("add_node", "a", None, {}), ("add_node", "b", None, {}), ("update_property", "a", "port", None), ("update_property", "b", "name", None), ("add_edge", "e", None, {})]
    m = small.materialize()
    assert small.verify_integrity() and any("/boxed-" in f for f in m.operations.inputFiles()) and ids(m.edges.select("edge_id")) == ["e"]
